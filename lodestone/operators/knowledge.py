"""Validation of knowledge objects and relationships: each rule is a DataFrame of diagnostics (level, code, message, source_ref)."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.operators.keyed import dimension


def _report(df: DataFrame, condition: Column, level: str, code: str, message, ref: str = "id") -> DataFrame:
    text = message if isinstance(message, Column) else F.lit(message)
    return df.filter(F.coalesce(condition, F.lit(False))).select(F.lit(level).alias("level"), F.lit(code).alias("code"), text.alias("message"), F.col(ref).alias("source_ref"))


def merge(reports: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, reports)


def ok(diagnostics: DataFrame) -> bool:
    return not diagnostics.filter("level = 'error'").take(1)


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def knowledge_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, k.replace("_", " ").title(), c, None) for k, c in schemas.KNOWLEDGE_TYPE_CATEGORIES.items()], schemas.KNOWLEDGE_TYPES)


def relationship_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, k.replace("_", " ").title(), k not in schemas.UNDIRECTED, None, None) for k in schemas.RELATIONSHIP_TYPE_IDS], schemas.RELATIONSHIP_TYPES)


def check_types(objects: DataFrame, types: DataFrame) -> DataFrame:
    """unknown_knowledge_type, and for types with a content schema: missing_content, invalid_content_shape, missing_required_field, field_type_mismatch.

    ``content`` is JSON text; a content schema has ``required`` and one level of ``properties.<name>.type``. Types are a small, registered
    dimension: those with a schema are compiled into conditions.
    """
    joined = objects.join(dimension(types.select(F.col("id").alias("type"), F.lit(True).alias("known")).dropDuplicates(["type"])), "type", "left")
    reports = [_report(joined, F.col("known").isNull(), "error", "unknown_knowledge_type", F.concat(F.lit("unknown type: "), "type"))]
    value = F.try_parse_json("content")
    kind_of = lambda v: F.schema_of_variant(v)
    for row in types.filter("content_schema IS NOT NULL").select("id", "content_schema").collect():
        spec = json.loads(row.content_schema)
        mine = objects.filter(F.col("type") == row.id).withColumn("v", value)
        reports.append(_report(mine, F.col("content").isNull(), "error", "missing_content", "content is missing"))
        shaped = kind_of(F.col("v")).startswith("OBJECT")
        reports.append(_report(mine, F.col("content").isNotNull() & ~F.coalesce(shaped, F.lit(False)), "error", "invalid_content_shape", "content is not an object"))
        mine = mine.filter(F.coalesce(shaped, F.lit(False))).withColumn("keys", F.json_object_keys("content"))
        for name in spec.get("required", []):
            reports.append(_report(mine, ~F.array_contains("keys", name), "error", "missing_required_field", f"missing field: {name}"))
        for name, rule in spec.get("properties", {}).items():
            wanted = rule.get("type")
            if wanted:
                kind = kind_of(F.try_variant_get(F.col("v"), f"$['{name}']", "variant"))
                reports.append(_report(mine, F.array_contains("keys", name) & ~_is_type(kind, wanted), "error", "field_type_mismatch", f"field {name} is not {wanted}"))
    return merge(reports)


def _is_type(kind: Column, wanted: str) -> Column:
    """Whether a variant's type name is the JSON type; booleans are no numbers."""
    patterns = {"string": "^STRING", "integer": "^(BIGINT|INT|SMALLINT|TINYINT)$", "number": "^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN", "array": "^ARRAY", "object": "^OBJECT", "null": "^VOID"}
    return F.coalesce(kind.rlike(patterns.get(wanted, ".*")), F.lit(wanted == "null"))


def check_relationships(relationships: DataFrame, objects: DataFrame, types: DataFrame) -> DataFrame:
    """unknown_relationship_type, missing_relationship_endpoint, invalid_from_type, invalid_to_type.

    ``relationships``: id, relationship_type, from_id, to_id. Objects meet by equi-joins, types by a broadcast where their table is small.
    """
    t = dimension(types.select(F.col("id").alias("relationship_type"), "allowed_from_types", "allowed_to_types", F.lit(True).alias("known")))
    kinds = objects.select(F.col("id").alias("o"), F.col("type").alias("k"))
    df = relationships.join(t, "relationship_type", "left")
    for side in ("from", "to"):
        df = df.join(kinds.toDF(f"{side}_o", f"{side}_k"), F.col(f"{side}_id") == F.col(f"{side}_o"), "left")
    reports = [_report(df, F.col("known").isNull(), "error", "unknown_relationship_type", F.concat(F.lit("unknown type: "), "relationship_type"))]
    for side in ("from", "to"):
        reports.append(_report(df, F.col(f"{side}_o").isNull(), "error", "missing_relationship_endpoint", F.concat(F.lit(f"{side} object does not exist: "), f"{side}_id")))
        allowed = F.col(f"allowed_{side}_types")
        reports.append(_report(df, (F.size(allowed) > 0) & ~F.array_contains(allowed, F.col(f"{side}_k")), "error", f"invalid_{side}_type", F.concat("relationship_type", F.lit(" does not allow "), f"{side}_k")))
    return merge(reports)


def check_evidence(objects: DataFrame, known: list[str] | None = None) -> DataFrame:
    """missing_evidence_source_uri, missing_evidence_source_kind, unknown_evidence_type (warning), invalid_confidence, per piece of evidence."""
    df = objects.select("id", F.explode("evidence").alias("e"))
    return merge([
        _report(df, blank(F.col("e.source.uri")), "error", "missing_evidence_source_uri", "evidence has no source uri"),
        _report(df, blank(F.col("e.source.kind")), "error", "missing_evidence_source_kind", "evidence has no source kind"),
        _report(df, ~F.col("e.type").isin(known or schemas.EVIDENCE_TYPES), "warning", "unknown_evidence_type", F.concat(F.lit("unknown evidence type: "), "e.type")),
        _report(df, ~F.col("e.confidence.value").between(0, 1), "error", "invalid_confidence", "confidence is outside 0 to 1"),
    ])


def check_traceability(objects: DataFrame) -> DataFrame:
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    return _report(objects, none("sources") & none("evidence"), "error", "missing_traceability", "neither sources nor evidence")


def check_metadata(objects: DataFrame) -> DataFrame:
    tags = F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("tags", "domain_tags")])
    return merge([
        _report(objects, blank(F.col("metadata.schema_version")), "error", "missing_schema_version", "no schema version"),
        _report(objects, blank(F.col("metadata.created_at")), "error", "missing_created_at", "no creation time"),
        _report(objects, F.exists(tags, lambda t: blank(t)), "error", "invalid_tag", "empty tag"),
    ])


def check_confidence(objects: DataFrame) -> DataFrame:
    return _report(objects, ~F.col("confidence.value").between(0, 1), "error", "invalid_confidence", "confidence is outside 0 to 1")


def check_lifecycle(objects: DataFrame) -> DataFrame:
    """lifecycle_version_mismatch and missing_superseded_by are errors, missing_archived_at and missing_previous_version warnings."""
    state = F.col("lifecycle.state")
    previous = objects.select("id", F.col("version.previous_version_id").alias("p")).filter("p IS NOT NULL")
    lost = previous.join(objects.select(F.col("id").alias("p")), "p", "left_anti")
    return merge([
        _report(objects, state != F.col("version.state"), "error", "lifecycle_version_mismatch", "lifecycle and version differ in state"),
        _report(objects, (state == "superseded") & F.col("lifecycle.superseded_by").isNull(), "error", "missing_superseded_by", "superseded by nothing"),
        _report(objects, (state == "archived") & F.col("lifecycle.archived_at").isNull(), "warning", "missing_archived_at", "archived without a time"),
        _report(lost, F.lit(True), "warning", "missing_previous_version", F.concat(F.lit("previous version does not exist: "), "p")),
    ])


def check_constraints(objects: DataFrame) -> DataFrame:
    """What the model itself demands: non-blank source kind and uri, a title, evidence with excerpt or location."""
    s = objects.select("id", F.explode("sources").alias("s"))
    e = objects.select("id", F.explode("evidence").alias("e"))
    return merge([
        _report(s, blank(F.col("s.kind")) | blank(F.col("s.uri")), "error", "invalid_source", "source kind and uri must not be blank"),
        _report(objects, F.coalesce(F.length("title"), F.lit(0)) == 0, "error", "missing_title", "title is empty"),
        _report(e, F.col("e.excerpt").isNull() & F.col("e.location").isNull(), "error", "invalid_evidence", "evidence needs an excerpt or a location"),
    ])


def duplicate_ids(df: DataFrame) -> DataFrame:
    return _report(df.groupBy("id").agg(F.count("*").alias("n")), F.col("n") > 1, "error", "duplicate_id", "id is not unique")


def validate_catalog(objects: DataFrame, relationships: DataFrame, types: DataFrame, relationship_kinds: DataFrame, more: list | None = None) -> DataFrame:
    """All rules over all objects and relationships; ``more`` are further functions of objects."""
    own = [check_types(objects, types), check_relationships(relationships, objects, relationship_kinds), duplicate_ids(objects)]
    own += [f(objects) for f in (check_evidence, check_traceability, check_metadata, check_confidence, check_lifecycle, check_constraints, *(more or []))]
    return merge(own)


def lifecycle_moves(log: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """``log`` with ``from_state`` and ``allowed``: whether each entry may follow the one before it of the same key; the first may always stand."""
    pairs = [f"{a}>{b}" for a, after in schemas.LIFECYCLE_MOVES.items() for b in after]
    df = log.withColumn("from_state", F.lag(state).over(Window.partitionBy(key).orderBy(*order)))
    move = F.concat("from_state", F.lit(">"), F.col(state))
    return df.withColumn("allowed", F.col("from_state").isNull() | (F.col("from_state") == F.col(state)) | move.isin(pairs))


def check_elements(elements: DataFrame) -> DataFrame:
    """Rules of document trees (schemas.ELEMENTS): element ids and types, uniqueness within a document, allowed children, locations, roots."""
    any_child = F.lit(False)
    for parent, children in schemas.ALLOWED_CHILDREN.items():
        any_child = F.when(F.col("parent_type") == parent, ~F.col("type").isin(children)).otherwise(any_child)
    place = Window.partitionBy("source_uri", "element_id").orderBy("seq")
    df = elements.withColumns({"nth": F.row_number().over(place), "wrong_child": any_child})
    root = F.col("parent_id").isNull()
    return merge([
        _report(df, root & (F.col("type") != "document"), "error", "invalid_canonical_root_type", "the root is no document", "source_uri"),
        _report(df, root & blank(F.col("source_uri")), "error", "missing_source_uri", "the document has no uri", "element_id"),
        _report(df, blank(F.col("element_id")), "error", "missing_element_id", "element without id", "source_uri"),
        _report(df, (F.col("nth") > 1) & ~blank(F.col("element_id")), "error", "duplicate_element_id", F.concat(F.lit("element id repeats: "), "element_id"), "source_uri"),
        _report(df, blank(F.col("type")), "error", "missing_element_type", "element without type", "source_uri"),
        _report(df, ~blank(F.col("type")) & ~F.col("type").isin(schemas.ELEMENT_TYPES), "warning", "unsupported_element_type", F.concat(F.lit("unknown element type: "), "type"), "source_uri"),
        _report(df, F.col("wrong_child"), "error", "invalid_child_element", F.concat("parent_type", F.lit(" cannot hold "), "type"), "source_uri"),
        _report(df, (F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line")), "warning", "invalid_location", "lines are out of order", "source_uri"),
    ])
