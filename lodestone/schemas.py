"""Schemas of the relations that the engine owns, and the fixed values of its model."""

from __future__ import annotations

#: Schemas are DDL texts, so that importing them needs no session.
SOURCE = "STRUCT<id: STRING, kind: STRING, uri: STRING, mime_type: STRING, digest: STRING>"
CONFIDENCE = "STRUCT<value: DOUBLE, method: STRING, timestamp: STRING, rationale: STRING>"
REFERENCE = "STRUCT<ref: STRING, kind: STRING, label: STRING, version: STRING>"
EVIDENCE = f"STRUCT<id: STRING, source: {SOURCE}, type: STRING, location: STRING, excerpt: STRING, confidence: {CONFIDENCE}, timestamp: STRING, extracted_by: STRING>"
METADATA = "STRUCT<schema_version: STRING, created_at: STRING, updated_at: STRING, project_id: STRING, domain: STRING, custom: MAP<STRING, STRING>>"
VERSION = "STRUCT<version_id: STRING, state: STRING, previous_version_id: STRING>"
LIFECYCLE = "STRUCT<state: STRING, superseded_by: STRING, archived_at: STRING, history: ARRAY<STRUCT<from_state: STRING, to_state: STRING, timestamp: STRING, actor: STRING>>>"

ARTIFACTS = (
    "id STRING, absolute_path STRING, relative_path STRING, type STRING, category STRING, extension STRING, hash STRING, size BIGINT, created_time TIMESTAMP, modified_time TIMESTAMP, "
    "parent_directory STRING, tags ARRAY<STRING>, status STRING, previous_path STRING, scan_seq BIGINT"
)
SEGMENTS = ("source_uri STRING, seq BIGINT, id STRING, type STRING, label STRING, content STRING, location STRING")
CANDIDATES = ("id STRING, source_uri STRING, seq BIGINT, knowledge_type STRING, title STRING, description STRING, content STRING, evidence_excerpt STRING, evidence_location STRING, segment_id STRING")
OBJECTS = (
    f"id STRING, type STRING, title STRING, description STRING, content STRING, sources ARRAY<{SOURCE}>, evidence ARRAY<{EVIDENCE}>, references ARRAY<{REFERENCE}>, metadata {METADATA}, version {VERSION}, "
    f"lifecycle {LIFECYCLE}, confidence {CONFIDENCE}, domain_tags ARRAY<STRING>, tags ARRAY<STRING>"
)
RELATIONSHIPS = (f"id STRING, relationship_type STRING, from_ref {REFERENCE}, to_ref {REFERENCE}, evidence ARRAY<{EVIDENCE}>, confidence {CONFIDENCE}")
NODES = (
    "id STRING, object_id STRING, type STRING, title STRING, labels ARRAY<STRING>, properties STRUCT<type: STRING, domain: STRING, project_id: STRING, lifecycle: STRING, confidence: DOUBLE, source: STRING, "
    "tags: ARRAY<STRING>, title: STRING, description: STRING>, metadata MAP<STRING, STRING>, seq BIGINT"
)
EDGES = ("id STRING, relationship_type STRING, source_id STRING, target_id STRING, directed BOOLEAN, properties STRUCT<confidence: DOUBLE, project_id: STRING, domain: STRING, evidence_count: BIGINT, synthetic: BOOLEAN>, relationship_id STRING, seq BIGINT")
DIAGNOSTICS = ("level STRING, code STRING, message STRING, source_ref STRING")
ELEMENTS = (
    "source_uri STRING, element_id STRING, parent_id STRING, parent_type STRING, ordinal BIGINT, depth INT, seq BIGINT, type STRING, level INT, content STRING, start_line INT, end_line INT, metadata STRING, error STRING"
)
KNOWLEDGE_TYPES = ("id STRING, name STRING, category STRING, content_schema STRING")
RELATIONSHIP_TYPES = ("id STRING, name STRING, directed BOOLEAN, allowed_from_types ARRAY<STRING>, allowed_to_types ARRAY<STRING>")

# ---- fixed values: they must equal those of the system whose results are matched ---------------------------------

SOURCE_KINDS = "markdown docx pdf html chatgpt claude gemini code email image audio video spreadsheet database manual unknown".split()
EVIDENCE_TYPES = "citation quotation summary derivation annotation manual extraction ai_extraction inferred".split()
#: Only related_to is undirected.
RELATIONSHIP_TYPE_IDS = "depends_on implements supersedes derived_from references contains belongs_to mitigates supports generated_from related_to".split()
UNDIRECTED = ("related_to",)
KNOWLEDGE_TYPE_CATEGORIES = {
    "decision": "governance", "requirement": "domain", "risk": "governance", "issue": "governance", "task": "execution", "timeline_event": "execution", "business_rule": "domain", "policy": "governance",
    "architecture_element": "engineering", "technology": "engineering", "component": "engineering", "capability": "domain", "process": "domain", "goal": "strategic", "objective": "strategic", "stakeholder": "domain",
    "entity": "domain", "glossary_term": "domain", "question": "evidence", "answer": "evidence", "prompt": "ai", "meeting": "communication", "conversation": "communication", "research_finding": "evidence",
    "metric": "execution", "constraint": "domain", "assumption": "domain", "dependency": "engineering", "action_item": "execution", "document": "media", "media": "media",
}
LIFECYCLE_STATES = ("draft", "published", "updated", "superseded", "archived")
#: From a state to those that may follow; staying is always allowed.
LIFECYCLE_MOVES = {"draft": ("published",), "published": ("updated", "superseded", "archived"), "updated": ("published", "superseded", "archived"), "superseded": ("archived",), "archived": ()}
CONFIDENCE_METHODS = ("manual", "ai", "algorithm", "inferred", "unknown")

#: Keywords of each knowledge type, in the order in which they are tried; they match anywhere in the lower-cased text.
KEYWORDS = {
    "decision": ["decision", "adr", "decided"],
    "requirement": ["requirement", "req", "must ", "shall", "should"],
    "risk": ["risk", "threat"],
    "issue": ["issue", "problem", "bug"],
    "task": ["task", "todo", "action item"],
    "goal": ["goal", "objective"],
    "metric": ["metric", "kpi", "measure"],
    "constraint": ["constraint", "limitation"],
    "assumption": ["assumption", "assume"],
    "component": ["component", "module", "class", "function"],
    "technology": ["technology", "library", "framework", "tool"],
    "business_rule": ["business rule", "rule"],
    "stakeholder": ["stakeholder", "customer", "user"],
}

#: File suffixes of each artifact type.
SUFFIXES = {
    "markdown": ".md .markdown",
    "text": ".txt .rst .log",
    "pdf": ".pdf",
    "docx": ".docx .doc",
    "pptx": ".pptx .ppt",
    "json": ".json",
    "yaml": ".yaml .yml",
    "xml": ".xml",
    "csv": ".csv",
    "toml": ".toml",
    "ini": ".ini",
    "source_code": ".py .js .ts .jsx .tsx .java .c .cpp .cc .h .hpp .go .rs .rb .php .sh .bash .zsh",
    "config": ".conf .cfg .env .properties",
    "image": ".png .jpg .jpeg .gif .svg .bmp .webp .ico",
    "video": ".mp4 .mov .avi .mkv .webm",
    "audio": ".mp3 .wav .ogg .flac .m4a",
    "archive": ".zip .tar .gz .bz2 .xz .rar .7z",
}
CATEGORIES = {
    "markdown": "document", "text": "document", "pdf": "document", "docx": "document", "pptx": "document", "json": "data", "yaml": "data", "xml": "data", "csv": "data", "toml": "config", "ini": "config",
    "source_code": "code", "config": "config", "image": "media", "video": "media", "audio": "media", "archive": "archive",
}

#: Names that are ignored everywhere, unless a user's rule says otherwise.
IGNORED = (
    ".DS_Store Thumbs.db desktop.ini *.lnk "
    ".vscode .idea *.swp *.swo *~ *.tmp .editorconfig "
    "__pycache__ *.pyc *.pyo .pytest_cache .mypy_cache .ruff_cache .sass-cache .cache *.cache *.log .coverage coverage .tox .nox *.egg-info "
    "node_modules bower_components vendor dist build target .next .nuxt out public/build "
    "venv .venv env virtualenv "
    ".git .hg .svn "
    ".lodestone "
    "*.zip *.tar *.gz *.bz2 *.xz *.rar *.7z *.tar.gz *.tgz *.tar.bz2 *.tar.xz"
).split()

#: Mime types by suffix. Pinned, as the tables of hosts differ; anything else is text/plain.
MIME_TYPES = {
    ".md": "text/markdown", ".markdown": "text/markdown", ".txt": "text/plain", ".rst": "text/x-rst", ".html": "text/html", ".htm": "text/html", ".css": "text/css", ".csv": "text/csv", ".tsv": "text/tab-separated-values",
    ".py": "text/x-python", ".js": "text/javascript", ".mjs": "text/javascript", ".c": "text/x-csrc", ".h": "text/x-chdr", ".json": "application/json", ".xml": "text/xml", ".pdf": "application/pdf",
    ".doc": "application/msword", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".ppt": "application/vnd.ms-powerpoint",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", ".sh": "application/x-sh", ".zip": "application/zip", ".tar": "application/x-tar", ".gz": "application/gzip",
    ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".svg": "image/svg+xml", ".bmp": "image/bmp", ".webp": "image/webp", ".ico": "image/vnd.microsoft.icon", ".tif": "image/tiff", ".tiff": "image/tiff",
    ".mp4": "video/mp4", ".mov": "video/quicktime", ".avi": "video/x-msvideo", ".webm": "video/webm", ".mpeg": "video/mpeg", ".mp3": "audio/mpeg", ".wav": "audio/x-wav", ".ogg": "audio/ogg", ".flac": "audio/flac", ".m4a": "audio/mp4", ".aac": "audio/aac",
}

_FLOW = "section heading paragraph list code table quote image link html page_break formula container other"
#: Child types that an element type may have; types that are not named here take any child.
ALLOWED_CHILDREN = {
    "document": (_FLOW + " footnote footnote_block metadata").split(),
    "section": _FLOW.split(),
    "list": "list_item task_list_item container other".split(),
    "task_list": "task_list_item list_item container other".split(),
    "table": "table_row table_head table_body container other".split(),
    "table_row": "table_cell container other".split(),
    "table_head": "table_row container other".split(),
    "table_body": "table_row container other".split(),
    "footnote_block": "footnote container other".split(),
}
ELEMENT_TYPES = (
    "document section heading paragraph list list_item task_list task_list_item code inline_code table table_head table_body table_row table_cell quote image link html footnote footnote_block metadata page_break formula container text other"
).split()
