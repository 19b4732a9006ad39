"""From segments to candidates, knowledge objects and their relationships."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import paths
from lodestone.functions.text import first_sentence, keyword_type_of_lowered, shortened, strip

TEXTUAL = ("paragraph", "semantic")


def candidates(segments: DataFrame) -> DataFrame:
    """Candidates by fixed rules, one projection: segments of other types, and those with empty containers or false values, give none.

    ``segments``: source_uri, stage (optional), seq, type, label, content, location. Ids are hashes of the place of the
    segment, so that reruns agree. Lists (JSON arrays of strings or of objects with ``text``) give one candidate per item.
    """
    if "stage" not in segments.columns:
        segments = segments.withColumn("stage", F.lit(0))
    seg = segments.withColumn("segment_id", F.left(F.sha2(F.concat_ws("|", "source_uri", "type", F.col("stage").cast("string"), F.col("seq").cast("string")), 256), F.lit(32)))
    text, own, label = F.col("content"), F.col("__own"), F.col("__label")
    is_, kind = (lambda *k: F.col("type").isin(*k)), F.col("type")
    plain = seg.filter(is_("heading", *TEXTUAL, "code", "table", "structural")).filter("content IS NOT NULL").filter(~((kind == "structural") & text.isin("0", "0.0", "false", "null", "[]", "{}")))
    # what later expressions look at often is computed once, in projections of its own
    plain = plain.withColumns({"__own": strip(text), "__label": F.coalesce(F.when(F.col("label") != "", F.col("label")), F.lit("structural item"))})
    plain = plain.withColumns({"__lowered": F.lower(F.when(is_("structural"), label).otherwise(own)), "__sentence": first_sentence(own), "__first": strip(F.split(text, "\r\n|[\n\r]")[0])})
    sentence, first_line = F.col("__sentence"), F.col("__first")
    code_title = F.when(first_line.startswith("#"), strip(F.regexp_replace(first_line, "^#+", ""))).otherwise("Code snippet")
    usual = F.when(is_("heading"), "goal").when(is_("structural"), "entity").otherwise("document")
    plain = plain.select(
        "source_uri", "stage", "seq", F.lit(0).alias("item"), "segment_id",
        F.when(is_("code"), "component").when(is_("table"), "business_rule").otherwise(keyword_type_of_lowered(F.col("__lowered"), usual)).alias("knowledge_type"),
        F.when(is_("heading"), own).when(is_(*TEXTUAL), F.when(sentence != "", sentence).otherwise(F.left(own, F.lit(80)))).when(is_("code"), code_title).when(is_("table"), strip(F.concat(F.lit("Table "), F.coalesce("location", F.lit(""))))).otherwise(shortened(label)).alias("title"),
        F.when(is_("heading", *TEXTUAL), own).when(is_("code"), F.concat(F.lit("Code block"), F.when(F.col("label") != "", F.concat(F.lit(" ("), "label", F.lit(")"))).otherwise(""))).when(is_("table"), "Extracted table").alias("description"),
        F.when(is_("heading"), None).when(is_(*TEXTUAL), own).otherwise(text).alias("content"),
        F.when(is_("heading", *TEXTUAL), own).otherwise(F.left(text, F.lit(200))).alias("evidence_excerpt"),
        F.col("location").alias("evidence_location"),
    )
    items = F.from_json(text, "array<string>")
    listed = seg.filter(is_("list", "task_list")).select("source_uri", "stage", "seq", "segment_id", "location", F.posexplode(items).alias("item", "raw"))
    value = strip(F.coalesce(F.get_json_object("raw", "$.text"), F.col("raw")))
    listed = listed.withColumn("t", value).filter("t <> ''").withColumn("__lowered", F.lower("t"))
    listed = listed.select(
        "source_uri", "stage", "seq", "item", "segment_id", keyword_type_of_lowered(F.col("__lowered"), "document").alias("knowledge_type"), first_sentence(F.col("t")).alias("title"), F.col("t").alias("description"), F.col("t").alias("content"), F.col("t").alias("evidence_excerpt"),
        F.when(F.coalesce("location", F.lit("")) != "", F.concat("location", F.lit("["), F.col("item").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("item "), F.col("item").cast("string"))).alias("evidence_location"),
    )
    both = plain.unionByName(listed)
    return both.withColumn("id", F.left(F.sha2(F.concat_ws("|", "segment_id", F.col("item").cast("string"), "title"), 256), F.lit(32)))


def check_candidates(found: DataFrame, known_types: list[str]) -> DataFrame:
    """``found`` with ``failed``: the first of missing_title, missing_knowledge_type, unknown_knowledge_type that holds, else null."""
    blank = lambda c: F.coalesce(strip(F.col(c)), F.lit("")) == ""
    return found.withColumn("failed", F.when(blank("title"), "missing_title").when(blank("knowledge_type"), "missing_knowledge_type").when(~F.col("knowledge_type").isin(known_types), "unknown_knowledge_type"))


def objects(found: DataFrame, project_id: str | None = None) -> DataFrame:
    """Knowledge objects of checked candidates; the evidence's excerpt is the candidate's, or its title where that is empty.

    ``found`` needs mime_type beside the candidate's columns.
    """
    source = F.struct(F.lit(None).cast("string").alias("id"), paths.source_kind(F.col("mime_type")).alias("kind"), F.col("source_uri").alias("uri"), F.col("mime_type"), F.lit(None).cast("string").alias("digest"))
    sure = F.struct(F.lit(1.0).alias("value"), F.lit("algorithm").alias("method"), F.lit(None).cast("string").alias("timestamp"), F.lit(None).cast("string").alias("rationale"))
    excerpt = F.coalesce(F.when(F.col("evidence_excerpt") != "", F.col("evidence_excerpt")), F.col("title"))
    evidence = F.struct(F.concat(F.lit("ev:"), "id").alias("id"), source.alias("source"), F.lit("extraction").alias("type"), F.col("evidence_location").alias("location"), excerpt.alias("excerpt"), sure.alias("confidence"), F.lit(None).cast("string").alias("timestamp"), F.lit("extraction").alias("extracted_by"))
    return found.filter("failed IS NULL").select(
        F.concat(F.lit("ku://"), "id").alias("id"), F.col("knowledge_type").alias("type"), "title", "description", "content", F.array(source).alias("sources"), F.array(evidence).alias("evidence"),
        sure.alias("confidence"), F.lit(project_id).cast("string").alias("project_id"), "source_uri",
    )


def file_objects(artifacts: DataFrame, project_id: str | None = None) -> DataFrame:
    """One object per file that may have content: code is a component, anything else a document; media, archives and office files have none."""
    path, suffix = F.col("relative_path"), paths.suffix_of(F.col("relative_path"))
    code = (suffix == ".py") | (F.col("type") == "source_code")
    textual = F.col("type").isin("markdown", "text") | suffix.isin(".md", ".txt", ".rst")
    df = artifacts.filter(~F.col("category").isin("media", "archive") & ~F.col("type").isin("pdf", "docx", "pptx", "directory"))
    return df.select(
        F.concat(F.lit("ku://file/"), path).alias("id"), F.when(code, "component").otherwise("document").alias("object_type"),
        F.when(code, "code").when(textual, F.when(F.col("type") == "markdown", "markdown").otherwise("text")).otherwise("manual").alias("source_kind"),
        F.when(suffix == ".py", paths.module_name(path)).otherwise(path).alias("title"), path.alias("description"), path.alias("relative_path"), F.col("category"), paths.mime_of(path).alias("mime_type"), F.lit(project_id).cast("string").alias("project_id"),
    )


def contains(files: DataFrame, found: DataFrame) -> DataFrame:
    """(id, relationship_type, source_id, target_id, excerpt): each file's object contains the objects found in it."""
    f = files.select(F.col("id").alias("source_id"), F.col("relative_path").alias("__p"), F.col("title").alias("__t"))
    df = found.join(f, found["source_uri"] == F.col("__p"))
    return df.select(F.concat(F.lit("contains:"), "source_id", F.lit("->"), found["id"]).alias("id"), F.lit("contains").alias("relationship_type"), "source_id", found["id"].alias("target_id"), F.concat("__t", F.lit(" contains "), found["title"]).alias("excerpt"))


def resolve_imports(imports: DataFrame, artifacts: DataFrame, files: DataFrame) -> DataFrame:
    """(source_id, target_id): the first of an import's candidate paths that exists, if it has a file object.

    ``imports``: relative_path, statement, candidates (paths in order of preference). An equi-join on the path; only the
    least position per statement stays.
    """
    wanted = imports.select("relative_path", "statement", F.posexplode("candidates").alias("rank", "target"))
    there = wanted.join(artifacts.select(F.col("relative_path").alias("target")).distinct(), "target")
    best = there.groupBy("relative_path", "statement").agg(F.min_by("target", "rank").alias("target"))
    source = files.select(F.col("relative_path"), F.col("id").alias("source_id"))
    target = files.select(F.col("relative_path").alias("target"), F.col("id").alias("target_id"))
    return best.join(source, "relative_path").join(target, "target").select("source_id", "target_id").distinct()
