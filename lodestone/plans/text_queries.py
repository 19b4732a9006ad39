"""Segmentation, extraction, discovery and validation over the tables."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.functions import paths
from lodestone.functions.text import first_sentence, keyword_type
from lodestone.operators import discovery as D
from lodestone.operators import extract as X
from lodestone.operators import knowledge as K
from lodestone.operators import segments as S
from lodestone.operators.structure import structure
from lodestone.plans.tables_graph import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# ---- documents with structure: headings, paragraphs, a fence and a table around each text ----------------------------

CONTENT_SQL = r"""d AS (SELECT 'doc/' || doc_id AS source_uri, '# Decision ' || source || chr(10) || chr(10) || replace(text, chr(10), chr(10) || chr(10)) || chr(10) || chr(10) || 'Requirement ' || lang || chr(10) || '=====' || chr(10) || chr(10)
  || '```py' || chr(10) || 'x = ' || doc_id || chr(10) || '```' || chr(10) || '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| 1 | ' || doc_id || ' |' || chr(10) AS content FROM documents),
l AS (SELECT source_uri, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM d)"""


def structured(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    nn = F.lit("\n\n")
    content = F.concat(
        F.lit("# Decision "), "source", nn, F.replace(F.col("text"), F.lit("\n"), nn), nn, F.lit("Requirement "), "lang", F.lit("\n=====\n\n```py\nx = "), F.col("doc_id").cast("string"),
        F.lit("\n```\n| a | b |\n|---|---|\n| 1 | "), F.col("doc_id").cast("string"), F.lit(" |\n"),
    )
    return docs.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("source_uri"), content.alias("content"))


@register(
    "segment_headings",
    f"WITH {CONTENT_SQL}, w AS (SELECT *, lead(line) OVER (PARTITION BY source_uri ORDER BY n) AS nxt FROM l) "
    r"SELECT source_uri, 'h' || length(regexp_extract(line, '^(#+)', 1)) AS label, trim(regexp_extract(line, '^#{1,6}\s+(.+?)(?:\s+#*)?$', 1)) AS content, 'line ' || n AS location FROM w WHERE regexp_matches(line, '^#{1,6}\s+.+$') "
    r"UNION ALL SELECT source_uri, CASE WHEN nxt LIKE '=%' THEN 'h1' ELSE 'h2' END, trim(line), 'line ' || n FROM w WHERE regexp_full_match(trim(nxt), '=+|-+')",
)
def headings(spark, d):
    return S.headings(structured(spark, d)).select("source_uri", "label", "content", "location")


@register(
    "segment_paragraphs",
    f"WITH {CONTENT_SQL}, " + r"b AS (SELECT source_uri, unnest(string_split_regex(content, '\n\s*\n')) AS raw, generate_subscripts(string_split_regex(content, '\n\s*\n'), 1) AS n FROM d), "
    "p AS (SELECT source_uri, n, trim(raw, chr(10) || ' ') AS block, 1 + coalesce(sum(length(raw) - length(replace(raw, chr(10), '')) + 2) OVER (PARTITION BY source_uri ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM b) "
    "SELECT source_uri, block AS content, 'line ' || line::BIGINT AS location FROM p WHERE block <> '' AND NOT starts_with(block, '#') AND NOT starts_with(block, '```') AND NOT ends_with(block, '```') "
    "AND NOT (len(list_filter(string_split(block, chr(10)), lambda x: NOT contains(x, '|'))) = 0 AND contains(block, '-'))",
)
def paragraphs(spark, d):
    return S.paragraphs(structured(spark, d)).select("source_uri", "content", "location")


@register(
    "segment_code",
    f"WITH {CONTENT_SQL} SELECT d.source_uri, 'py' AS label, 'x = ' || split_part(d.source_uri, '/', 2) AS content, 'code block 1 (line ' || min(n) || ')' AS location FROM d JOIN l ON l.source_uri = d.source_uri AND line = '```py' GROUP BY d.source_uri",
)
def code(spark, d):
    return S.code_blocks(structured(spark, d)).select("source_uri", "label", "content", "location")


@register(
    "segment_tables",
    f"WITH {CONTENT_SQL}, t AS (SELECT *, n - row_number() OVER (PARTITION BY source_uri ORDER BY n) AS island FROM l WHERE contains(line, '|')), "
    r"s AS (SELECT source_uri, island, min(n) AS a, max(n) AS b, count(*) FILTER (NOT (regexp_full_match(line, '[-:| \t]*') AND contains(line, '-')))::INTEGER AS n_rows FROM t GROUP BY ALL) "
    "SELECT source_uri, 'lines ' || a || '-' || b AS location, n_rows FROM s WHERE n_rows > 0",
)
def tables(spark, d):
    return S.tables(structured(spark, d)).select("source_uri", "location", F.json_array_length("content").alias("n_rows"))


@register(
    "segment_sentences",
    r"WITH s AS (SELECT conv_id || '/' || turn AS source_uri, string_split(regexp_replace(trim(text, chr(10) || ' '), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM conversations), "
    "u AS (SELECT source_uri, unnest(parts) AS content, generate_subscripts(parts, 1) AS n FROM s), "
    "v AS (SELECT *, 1 + coalesce(sum(length(content) - length(replace(content, chr(10), '')) + 1) OVER (PARTITION BY source_uri ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM u WHERE content <> '') "
    "SELECT source_uri, content, 'line ' || line::BIGINT AS location FROM v",
)
def sentences(spark, d):
    docs = table(spark, d, "conversations").select(F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("source_uri"), F.col("text").alias("content"))
    return S.sentences(docs).select("source_uri", "content", "location")


def keyword_sql(text: str, default: str) -> str:
    arms = " ".join("WHEN " + " OR ".join(f"contains(lower({text}), '{k}')" for k in ks) + f" THEN '{t}'" for t, ks in schemas.KEYWORDS.items())
    return f"CASE {arms} ELSE '{default}' END"


KINDS = ["", *schemas.KEYWORDS]
TITLE_SQL = "list_extract([" + ", ".join(f"'{k}'" for k in KINDS) + f"], (p_partkey % {len(KINDS)} + 1)::INTEGER) || ': ' || p_name || '. ' || p_type || '! More'"


def part_titles(spark, d) -> DataFrame:
    parts = table(spark, d, "part")
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("p_partkey") % len(KINDS) + 1).cast("int"))
    return parts.select("p_partkey", F.concat(kind, F.lit(": "), "p_name", F.lit(". "), "p_type", F.lit("! More")).alias("t"))


@register("keyword_types", f"WITH t AS (SELECT p_partkey, {TITLE_SQL} AS t FROM part) SELECT p_partkey, {keyword_sql('t', 'document')} AS knowledge_type FROM t")
def keywords(spark, d):
    return part_titles(spark, d).select("p_partkey", keyword_type(F.col("t"), "document").alias("knowledge_type"))


@register("first_sentence_titles", f"WITH t AS (SELECT p_partkey, {TITLE_SQL} AS t FROM part) SELECT p_partkey, coalesce(nullif(trim(regexp_extract(t, '^[^.!?]+[.!?]')), ''), left(trim(t), 80)) AS title FROM t")
def first_sentences(spark, d):
    return part_titles(spark, d).select("p_partkey", first_sentence(F.col("t")).alias("title"))


@register(
    "candidates_of_headings",
    f"WITH {CONTENT_SQL}, w AS (SELECT *, lead(line) OVER (PARTITION BY source_uri ORDER BY n) AS nxt FROM l), "
    r"h AS (SELECT source_uri, trim(regexp_extract(line, '^#{1,6}\s+(.+?)(?:\s+#*)?$', 1)) AS title, 'line ' || n AS location FROM w WHERE regexp_matches(line, '^#{1,6}\s+.+$') UNION ALL SELECT source_uri, trim(line), 'line ' || n FROM w WHERE regexp_full_match(trim(nxt), '=+|-+')) "
    f"SELECT source_uri, {keyword_sql('title', 'goal')} AS knowledge_type, title, location AS evidence_location, CASE WHEN title = '' THEN 'missing_title' END AS failed FROM h",
)
def heading_candidates(spark, d):
    found = X.check_candidates(X.candidates(S.headings(structured(spark, d))), list(schemas.KNOWLEDGE_TYPE_CATEGORIES))
    return found.select("source_uri", "knowledge_type", "title", "evidence_location", "failed")


@register("candidate_tallies")
def candidate_tallies(spark, d):
    return X.candidates(S.text_segments(structured(spark, d))).groupBy("source_uri", "knowledge_type").agg(F.count("*").alias("n"))


@register(
    "json_flatten",
    "SELECT 'event/' || event_id AS source_uri, j.key AS label, json_extract_string(props, '$.' || j.key) AS content, j.key AS location FROM events, json_each(props) j",
)
def json_flatten(spark, d):
    docs = table(spark, d, "events").select(F.concat(F.lit("event/"), F.col("event_id").cast("string")).alias("source_uri"), F.col("props").alias("content"), F.lit("application/json").alias("mime_type"))
    return structure(docs).select("source_uri", "label", "content", "location")


# ---- discovery --------------------------------------------------------------------------------------------------------

SUFFIXES = [".md", ".py", ".JSON", ".yaml", ".png", ".mp3", ".zip", ".html", ".xyz", "", ".cfg", ".tar.gz", ".log", ".pyc"]
FOLDERS = ["src", "docs", "build", "node_modules/x", ".git", "src/app", "out/deep", "my_build", "vendor.d", "data"]
USER_RULES = ["# user rules", "/docs", "!*.md", "*.xyz", "!/src/app"]
PATHS_SQL = (
    "f AS (SELECT page_id, list_extract([" + ", ".join(f"'{x}'" for x in FOLDERS) + f"], (page_id % {len(FOLDERS)} + 1)::INTEGER) || '/file' || page_id || list_extract([" + ", ".join(f"'{x}'" for x in SUFFIXES) + f"], (page_id // 3 % {len(SUFFIXES)} + 1)::INTEGER) AS relative_path FROM pages)"
)


def file_paths(spark, d) -> DataFrame:
    pick = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (i % len(xs) + 1).cast("int"))
    third = F.floor(F.col("page_id") / 3)
    path = F.concat(pick(FOLDERS, F.col("page_id")), F.lit("/file"), F.col("page_id").cast("string"), pick(SUFFIXES, third))
    return table(spark, d, "pages").select("page_id", path.alias("relative_path"), F.lit(False).alias("is_directory"))


def _type_sql() -> str:
    suffix = r"lower(regexp_extract(relative_path, '[^/](\.[^./]+)$', 1))"
    arms = " ".join(f"WHEN {suffix} IN ({', '.join(repr(s) for s in ss.split())}) THEN '{t}'" for t, ss in schemas.SUFFIXES.items())
    return f"CASE {arms} WHEN {suffix} = '.html' THEN 'text' ELSE 'unknown' END"


@register(
    "artifact_classify",
    f"WITH {PATHS_SQL}, t AS (SELECT *, {_type_sql()} AS type FROM f) SELECT relative_path, type, CASE type " + " ".join(f"WHEN '{t}' THEN '{c}'" for t, c in schemas.CATEGORIES.items()) + r" ELSE 'unknown' END AS category, lower(regexp_extract(relative_path, '[^/]\.([^./]+)$', 1)) AS extension, left(sha256(relative_path), 32) AS id, regexp_extract(relative_path, '^(.*)/[^/]*$', 1) AS parent_directory FROM t",
)
def artifact_classify(spark, d):
    return D.classify(file_paths(spark, d)).select("relative_path", "type", "category", "extension", "id", "parent_directory")


@register(
    "ignore_verdict",
    f"WITH {PATHS_SQL}, v AS (SELECT relative_path, CASE WHEN starts_with(relative_path, 'src/app/') THEN false WHEN relative_path LIKE '%.xyz' THEN true WHEN relative_path LIKE '%.md' THEN false WHEN starts_with(relative_path, 'docs/') THEN true END AS usr, "
    r"len(list_intersect(string_split(relative_path, '/'), ['build', 'node_modules', '.git', 'out', 'vendor'])) > 0 OR regexp_matches(relative_path, '\.(zip|gz|tar|log|pyc)$') AS own FROM f) "
    "SELECT relative_path, coalesce(usr, own) AS ignored, CASE WHEN usr THEN 'user' WHEN usr IS NULL AND own THEN 'built_in' END AS reason FROM v",
)
def ignore_verdict(spark, d):
    return D.ignore_verdict(file_paths(spark, d), D.parse_rules(USER_RULES, "user")).select("relative_path", "ignored", "reason")


@register("mime_and_module", f"WITH {PATHS_SQL} SELECT relative_path, CASE WHEN relative_path LIKE '%.py' THEN replace(regexp_replace(relative_path, '\\.py$', ''), '/', '.') END AS module FROM f")
def mime_and_module(spark, d):
    path = F.col("relative_path")
    return file_paths(spark, d).select("relative_path", F.when(paths.suffix_of(path) == ".py", paths.module_name(path)).alias("module"))


SNAPSHOT_SQL = """
base AS (SELECT doc_id, 'src/' || source || '/' || doc_id AS path, text FROM documents),
prev AS (SELECT path AS relative_path, sha256(text) AS hash, doc_id AS seq FROM base WHERE doc_id % 10 <> 0),
cur AS (SELECT CASE WHEN doc_id % 11 = 0 THEN 'moved/' || split_part(path, '/', 2) || '/' || doc_id ELSE path END AS relative_path, sha256(CASE WHEN doc_id % 13 = 0 THEN text || '!' ELSE text END) AS hash, doc_id AS seq FROM base WHERE doc_id % 7 <> 0),
j AS (SELECT coalesce(c.relative_path, p.relative_path) AS relative_path, c.hash AS h, p.hash AS oh, c.seq AS s, p.seq AS os FROM cur c FULL JOIN prev p ON c.relative_path = p.relative_path),
n AS (SELECT relative_path, h AS k, row_number() OVER (PARTITION BY h ORDER BY s, relative_path) AS r FROM j WHERE oh IS NULL),
g AS (SELECT relative_path AS old, oh AS k, row_number() OVER (PARTITION BY oh ORDER BY os, relative_path) AS r FROM j WHERE h IS NULL),
diff AS (
  SELECT relative_path, NULL AS previous_path, CASE WHEN h = oh THEN 'unchanged' ELSE 'modified' END AS status FROM j WHERE h IS NOT NULL AND oh IS NOT NULL
  UNION ALL SELECT coalesce(n.relative_path, old), CASE WHEN n.relative_path IS NOT NULL THEN old END, CASE WHEN old IS NULL THEN 'new' WHEN n.relative_path IS NULL THEN 'deleted' ELSE 'renamed' END FROM n FULL JOIN g ON n.k = g.k AND n.r = g.r
)"""


def snapshots(spark, d) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").withColumn("path", F.concat(F.lit("src/"), "source", F.lit("/"), F.col("doc_id").cast("string")))
    moved = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("moved/"), "source", F.lit("/"), F.col("doc_id").cast("string"))).otherwise(F.col("path"))
    text = F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    shape = lambda df, p, t: df.select(p.alias("relative_path"), F.sha2(t, 256).alias("hash"), F.octet_length(t).cast("long").alias("size"), F.col("doc_id").alias("scan_seq"))
    return shape(docs.filter("doc_id % 10 <> 0"), F.col("path"), F.col("text")), shape(docs.filter("doc_id % 7 <> 0"), moved, text)


@register("snapshot_diff", f"WITH {SNAPSHOT_SQL} SELECT relative_path, previous_path, status FROM diff")
def snapshot_diff(spark, d):
    return D.snapshot_diff(*snapshots(spark, d))


@register("rename_pairs", f"WITH {SNAPSHOT_SQL} SELECT relative_path, previous_path FROM diff WHERE status = 'renamed'")
def rename_pairs(spark, d):
    return D.snapshot_diff(*snapshots(spark, d)).filter("status = 'renamed'").drop("status")


@register("change_tallies", f"WITH {SNAPSHOT_SQL} SELECT status, count(*) AS n FROM diff GROUP BY status")
def change_tallies(spark, d):
    return D.change_tallies(D.snapshot_diff(*snapshots(spark, d)))


# ---- knowledge validation ----------------------------------------------------------------------------------------------


def objects(spark, d) -> DataFrame:
    """Knowledge objects from customers, with faults that depend on the key."""
    k = F.col("c_custkey")
    every = lambda n: k % n == 0
    source = F.struct(F.lit(None).cast("string").alias("id"), F.when(every(31), " ").otherwise("database").alias("kind"), F.concat(F.lit("customer/"), k.cast("string")).alias("uri"), F.lit(None).cast("string").alias("mime_type"), F.lit(None).cast("string").alias("digest"))
    confidence = F.struct(((F.col("c_acctbal") + 1000) / 10000).alias("value"), F.lit("algorithm").alias("method"), F.lit(None).cast("string").alias("timestamp"), F.lit(None).cast("string").alias("rationale"))
    evidence = F.struct(F.lit(None).cast("string").alias("id"), source.alias("source"), F.when(every(17), "rumour").otherwise("extraction").alias("type"), F.lit(None).cast("string").alias("location"), F.when(~every(37), F.col("c_name")).alias("excerpt"), confidence.alias("confidence"), F.lit(None).cast("string").alias("timestamp"), F.lit(None).cast("string").alias("extracted_by"))
    state = F.element_at(F.array(*[F.lit(s) for s in schemas.LIFECYCLE_STATES]), (k % 5 + 1).cast("int"))
    e = lambda c: F.when(every(7), F.array().cast(f"array<{c}>"))
    return table(spark, d, "customer").select(
        F.concat(F.lit("c"), k.cast("string")).alias("id"), F.when(every(23), "mystery").otherwise("stakeholder").alias("type"), F.when(every(41), "").otherwise(F.col("c_name")).alias("title"), F.lit(None).cast("string").alias("content"),
        F.coalesce(e(schemas.SOURCE.replace(": ", ":")), F.array(source)).alias("sources"), F.coalesce(e(schemas.EVIDENCE.replace(": ", ":")), F.array(evidence)).alias("evidence"), confidence.alias("confidence"),
        F.struct(F.when(~every(13), "1").alias("schema_version"), F.lit("2024").alias("created_at")).alias("metadata"), F.array("c_mktsegment", F.when(every(19), " ").otherwise("x")).alias("tags"), F.array().cast("array<string>").alias("domain_tags"),
        F.struct(state.alias("state"), F.when(every(2), "c1").alias("superseded_by"), F.when(every(3), "2024").alias("archived_at")).alias("lifecycle"),
        F.struct(F.when(every(11), "draft").otherwise(state).alias("state"), F.when(every(29), F.concat(F.lit("c"), (k * 2).cast("string"))).alias("previous_version_id")).alias("version"),
    )


O = "SELECT 'c' || c_custkey AS source_ref, '{0}' AS level, '{1}' AS code FROM customer WHERE {2}"  # noqa: E741


def faults(*rows: tuple[str, str, str]) -> str:
    return " UNION ALL ".join(O.format(*r) for r in rows)


def short(df: DataFrame) -> DataFrame:
    return df.select("source_ref", "level", "code")


@register("validate_types", faults(("error", "unknown_knowledge_type", "c_custkey % 23 = 0")))
def validate_types(spark, d):
    return short(K.check_types(objects(spark, d), K.knowledge_types(spark)))


@register("validate_traceability", faults(("error", "missing_traceability", "c_custkey % 7 = 0")))
def validate_traceability(spark, d):
    return short(K.check_traceability(objects(spark, d)))


@register("validate_metadata", faults(("error", "missing_schema_version", "c_custkey % 13 = 0"), ("error", "invalid_tag", "c_custkey % 19 = 0")))
def validate_metadata(spark, d):
    return short(K.check_metadata(objects(spark, d)))


@register("validate_confidence", faults(("error", "invalid_confidence", "NOT ((c_acctbal + 1000) / 10000 BETWEEN 0 AND 1)")))
def validate_confidence(spark, d):
    return short(K.check_confidence(objects(spark, d)))


@register("validate_evidence", faults(("error", "missing_evidence_source_kind", "c_custkey % 31 = 0 AND c_custkey % 7 <> 0"), ("warning", "unknown_evidence_type", "c_custkey % 17 = 0 AND c_custkey % 7 <> 0"), ("error", "invalid_confidence", "NOT ((c_acctbal + 1000) / 10000 BETWEEN 0 AND 1) AND c_custkey % 7 <> 0")))
def validate_evidence(spark, d):
    return short(K.check_evidence(objects(spark, d)))


@register(
    "validate_lifecycle",
    faults(
        ("error", "lifecycle_version_mismatch", "c_custkey % 11 = 0 AND c_custkey % 5 <> 0"), ("error", "missing_superseded_by", "c_custkey % 5 = 3 AND c_custkey % 2 <> 0"), ("warning", "missing_archived_at", "c_custkey % 5 = 4 AND c_custkey % 3 <> 0"),
        ("warning", "missing_previous_version", "c_custkey % 29 = 0 AND c_custkey * 2 NOT IN (SELECT c_custkey FROM customer)"),
    ),
)
def validate_lifecycle(spark, d):
    return short(K.check_lifecycle(objects(spark, d)))


@register("validate_constraints", faults(("error", "invalid_source", "c_custkey % 31 = 0 AND c_custkey % 7 <> 0"), ("error", "missing_title", "c_custkey % 41 = 0"), ("error", "invalid_evidence", "c_custkey % 37 = 0 AND c_custkey % 7 <> 0")))
def validate_constraints(spark, d):
    return short(K.check_constraints(objects(spark, d)))


@register(
    "validate_relationships",
    "WITH r AS (SELECT o_orderkey, 'r' || o_orderkey AS source_ref, o_custkey, CASE WHEN o_orderkey % 9 = 0 THEN 'owns' WHEN o_orderkey % 2 = 0 THEN 'supports' ELSE 'depends_on' END AS t, o_custkey + CASE WHEN o_orderkey % 15 = 0 THEN 100000000 ELSE 0 END AS f FROM orders) "
    "SELECT source_ref, 'error' AS level, 'unknown_relationship_type' AS code FROM r WHERE t = 'owns' UNION ALL SELECT source_ref, 'error', 'missing_relationship_endpoint' FROM r WHERE f NOT IN (SELECT c_custkey FROM customer) "
    "UNION ALL SELECT source_ref, 'error', 'invalid_to_type' FROM r WHERE t = 'supports' AND o_custkey % 23 = 0",
)
def validate_relationships(spark, d):
    k = F.col("o_orderkey")
    c = lambda x: F.concat(F.lit("c"), x.cast("string"))
    rel = table(spark, d, "orders").select(
        F.concat(F.lit("r"), k.cast("string")).alias("id"), F.when(k % 9 == 0, "owns").when(k % 2 == 0, "supports").otherwise("depends_on").alias("relationship_type"),
        c(F.col("o_custkey") + F.when(k % 15 == 0, 100_000_000).otherwise(0)).alias("from_id"), c(F.col("o_custkey")).alias("to_id"),
    )
    types = spark.createDataFrame([("supports", ["stakeholder", "mystery"], ["stakeholder"]), ("depends_on", None, None)], "id string, allowed_from_types array<string>, allowed_to_types array<string>")
    return short(K.check_relationships(rel, objects(spark, d), types))


STATE_SQL = "CASE o_orderstatus WHEN 'O' THEN 'published' WHEN 'F' THEN 'archived' ELSE 'updated' END"


@register(
    "validate_lifecycle_transitions",
    f"WITH s AS (SELECT o_orderkey, o_custkey, o_orderdate, {STATE_SQL} AS state FROM orders), w AS (SELECT *, lag(state) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS from_state FROM s) "
    "SELECT o_orderkey, from_state, state, from_state IS NULL OR from_state = state OR (from_state || '>' || state) IN (" + ", ".join(f"'{a}>{b}'" for a, bs in schemas.LIFECYCLE_MOVES.items() for b in bs) + ") AS allowed FROM w",
)
def lifecycle_transitions(spark, d):
    state = F.when(F.col("o_orderstatus") == "O", "published").when(F.col("o_orderstatus") == "F", "archived").otherwise("updated")
    log = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", state.alias("state"))
    return K.lifecycle_moves(log, "o_custkey", ["o_orderdate", "o_orderkey"], "state").select("o_orderkey", "from_state", "state", "allowed")


