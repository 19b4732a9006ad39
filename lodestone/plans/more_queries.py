"""Lookups, projections, parsers and catalogs over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import paths
from lodestone.functions.text import cypher_string, diagnostic_line, dot_label, line_of, location, shortened
from lodestone.operators import extract as X
from lodestone.operators import graph as G
from lodestone.operators import knowledge as K
from lodestone.operators import lookup as L
from lodestone.operators import markdown, pycode
from lodestone.operators import segments as S
from lodestone.plans import tables_graph as T
from lodestone.plans.tables_graph import table
from lodestone.plans.text_queries import structured
from lodestone.sources import catalog

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# ---- objects and relationships of the tables ------------------------------------------------------------------------------


def relationships(spark, d) -> DataFrame:
    """belongs_to from customers to nations, with as many pieces of evidence as the key's remainder by three; nations that do not exist are of another kind."""
    ref = lambda kind, c, k: F.struct(F.concat(F.lit(f"{kind}:"), F.col(c).cast("string")).alias("ref"), k.alias("kind"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("version"))
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        F.concat(F.lit("r"), k.cast("string")).alias("id"), F.when(k % 4 == 0, "related_to").otherwise("belongs_to").alias("relationship_type"), ref("customer", "c_custkey", F.lit("knowledge_object")).alias("from_ref"),
        ref("nation", "c_nationkey", F.when(k % 10 == 0, "external").otherwise("knowledge_object")).alias("to_ref"), F.slice(F.array(F.lit(1), F.lit(2)), 1, (k % 3).cast("int")).alias("evidence"), F.struct(F.lit(0.5).alias("value")).alias("confidence"),
    )


@register(
    "edge_projection",
    "SELECT 'r' || c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'related_to' ELSE 'belongs_to' END AS relationship_type, 'customer:' || c_custkey AS source_id, 'nation:' || c_nationkey AS target_id, c_custkey % 4 <> 0 AS directed, c_custkey % 3 AS evidence_count FROM customer WHERE c_custkey % 10 <> 0",
)
def edge_projection(spark, d):
    out = G.edges_of(relationships(spark, d), K.relationship_types(spark))
    return out.select("id", "relationship_type", "source_id", "target_id", "directed", F.col("properties.evidence_count").alias("evidence_count"))


def with_references(spark, d) -> DataFrame:
    """Orders that refer to their customer twice and, every third one, to a file."""
    ref = lambda r, k: F.struct(r.alias("ref"), F.lit(k).alias("kind"))
    customer = T.ref("customer", "o_custkey")
    refs = F.filter(F.array(ref(customer, "knowledge_object"), F.when(F.col("o_orderkey") % 3 == 0, ref(F.lit("file:x"), "file")), ref(customer, "knowledge_object")), lambda r: r.isNotNull())
    return table(spark, d, "orders").select(T.ref("order", "o_orderkey").alias("id"), refs.alias("references"), F.array(F.struct(F.col("o_orderpriority").alias("uri")), F.struct(F.lit("second").alias("uri"))).alias("sources"))


@register("reference_edges", "SELECT 'ref:order:' || o_orderkey || '->customer:' || o_custkey AS id, 'order:' || o_orderkey AS source_id, 'customer:' || o_custkey AS target_id FROM orders")
def reference_edges(spark, d):
    return G.reference_edges(with_references(spark, d)).select("id", "source_id", "target_id")


@register("references_object", "SELECT 'order:' || o_orderkey AS id FROM orders WHERE o_custkey = 7")
def references_object(spark, d):
    return with_references(spark, d).filter(L.references_object(F.col("references"), "customer:7")).select("id")


@register("primary_source", "SELECT 'order:' || o_orderkey AS id, o_orderpriority AS uri FROM orders")
def primary_source(spark, d):
    return with_references(spark, d).select("id", L.primary_source(F.col("sources")).getField("uri").alias("uri"))


@register("relationships_of_ref", "SELECT 'r' || c_custkey AS id FROM customer WHERE c_nationkey = 3")
def relationships_of_ref(spark, d):
    flat = relationships(spark, d).select("id", F.col("from_ref.ref").alias("from_id"), F.col("to_ref.ref").alias("to_id"))
    return L.relationships_of(flat, "nation:3", "incoming").select("id")


@register("point_lookup", f"WITH {T.NODES_SQL} SELECT id, type, title FROM nodes WHERE id = 'part:17'")
def point_lookup(spark, d):
    return L.by_key(T.nodes(spark, d), "part:17").select("id", "type", "title")


@register(
    "posting_list_sizes",
    f"WITH {T.NODES_SQL}, p AS (SELECT id, 'tag' AS attribute, type AS value FROM nodes UNION SELECT id, 'tag', tag FROM nodes UNION SELECT id, 'type', type FROM nodes UNION SELECT id, 'domain', domain FROM nodes UNION SELECT id, 'source', type || '.parquet' FROM nodes "
    "UNION SELECT id, 'lifecycle', lifecycle FROM nodes UNION SELECT id, 'project_id', 'demo' FROM nodes) SELECT attribute, value, count(*) AS n FROM p GROUP BY ALL",
)
def posting_sizes(spark, d):
    return L.posting_sizes(T.nodes(spark, d))


# ---- scalar functions -----------------------------------------------------------------------------------------------------


@register("stable_ids", "SELECT c_custkey, left(sha256(c_name), 32) AS id, sha256(c_mktsegment) AS hash FROM customer")
def stable_ids(spark, d):
    return table(spark, d, "customer").select("c_custkey", paths.stable_id(F.col("c_name")).alias("id"), paths.content_hash(F.col("c_mktsegment").cast("binary"), F.lit(1)).alias("hash"))


@register(
    "text_helpers",
    "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 5 = 1 THEN 'line ' || p_size ELSE 'lines ' || p_size || '-' || (p_size + p_size % 5 - 1) END AS place, CASE WHEN length(p_type || p_name || p_type || p_name) > 40 THEN left(p_type || p_name || p_type || p_name, 37) || '...' ELSE p_type || p_name || p_type || p_name END AS short, "
    "replace(replace(left(p_name || '\"' || chr(10) || p_type, 80), '\"', '\\\"'), chr(10), ' ') AS dot, '\"' || replace(replace(p_name || '\"' || chr(10), '\"', '\\\"'), chr(10), ' ') || '\"' AS cypher, '[WARNING:' || p_brand || '] ' || p_name AS diagnostic, 3 AS line FROM part",
)
def text_helpers(spark, d):
    size = F.col("p_size")
    start = F.when(size % 5 != 0, size)
    long = F.concat("p_type", "p_name", "p_type", "p_name")
    return table(spark, d, "part").select(
        "p_partkey", location(start, start + size % 5 - 1).alias("place"), shortened(long, 40).alias("short"), dot_label(F.concat("p_name", F.lit('"\n'), "p_type")).alias("dot"), cypher_string(F.concat("p_name", F.lit('"\n'))).alias("cypher"),
        diagnostic_line(F.lit("warning"), F.col("p_brand"), F.col("p_name")).alias("diagnostic"), line_of(F.lit("a\nb\n")).alias("line"),
    )


# ---- parsers ----------------------------------------------------------------------------------------------------------------


@register("candidate_counts")
def candidate_counts(spark, d):
    return X.candidates(S.text_segments(structured(spark, d))).groupBy("source_uri").agg(F.count("*").alias("n"))


@register(
    "markdown_elements",
    "WITH t AS (SELECT 'conv/' || conv_id || '/' || turn AS source_uri, trim(text) AS text FROM conversations) SELECT source_uri, 'h2' AS label, 'Turn' AS content, 'line 1' AS location FROM t UNION ALL SELECT source_uri, 'list', '[\"first\", \"second\"]', 'lines 3-4' FROM t "
    "UNION ALL SELECT source_uri, 'py', 'x = 1', 'lines 6-8' FROM t UNION ALL SELECT source_uri, 'table', '[[\"a\", \"b\"], [\"1\", \"2\"]]', 'lines 10-12' FROM t",
)
def markdown_elements(spark, d):
    head = "## Turn\n\n- first\n- second\n\n```py\nx = 1\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n"
    docs = table(spark, d, "conversations").select(F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("source_uri"), F.concat(F.lit(head), "text").alias("content"))
    segments = markdown.element_segments(markdown.elements(docs))
    return segments.filter(F.col("type").isin("heading", "list", "code", "table") & F.col("location").isin("line 1", "lines 3-4", "lines 6-8", "lines 10-12")).select("source_uri", "label", "content", "location")


@register(
    "python_components",
    "WITH f AS (SELECT p_partkey, 'pkg/m' || p_partkey || '.py' AS relative_path FROM part) "
    "SELECT relative_path, 'ku://comp/pkg.m' || p_partkey || '/func/f' || p_partkey AS id, 'def f' || p_partkey || '()' AS title, 'line 3' AS location FROM f UNION ALL SELECT relative_path, 'ku://comp/pkg.m' || p_partkey || '/class/K', 'class K', 'line 6' FROM f "
    "UNION ALL SELECT relative_path, 'ku://comp/pkg.m' || p_partkey || '/func/K.run', 'method K.run()', 'line 7' FROM f UNION ALL SELECT relative_path, 'ku://comp/pkg.m' || p_partkey || '/var/X', 'X = ' || p_partkey, 'line 9' FROM f",
)
def python_components(spark, d):
    return pycode.first_of_each(pycode.parse_components(python_files(spark, d))).select("relative_path", "id", "title", "location")


def python_files(spark, d) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    source = F.concat(F.lit("import os\nfrom . import m"), (F.col("p_partkey") + 1).cast("string"), F.lit("\ndef f"), key, F.lit("():\n    return 1\n\nclass K:\n    async def run(self):\n        pass\nX = "), key, F.lit("\n"))
    return table(spark, d, "part").select(F.concat(F.lit("pkg/m"), key, F.lit(".py")).alias("relative_path"), source.alias("content"))


@register("import_edges", "SELECT 'ku://file/pkg/m' || a.p_partkey || '.py' AS source_id, 'ku://file/pkg/m' || b.p_partkey || '.py' AS target_id FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def import_edges(spark, d):
    files = python_files(spark, d)
    artifacts = files.select("relative_path", F.lit("code").alias("category"), F.lit("source_code").alias("type"))
    return X.resolve_imports(pycode.parse_imports(files), artifacts, X.file_objects(artifacts))


@register("file_objects", "SELECT 'ku://file/pkg/m' || p_partkey || '.py' AS id, 'component' AS object_type, 'code' AS source_kind, 'pkg.m' || p_partkey AS title, 'text/x-python' AS mime_type FROM part")
def file_objects(spark, d):
    artifacts = python_files(spark, d).select("relative_path", F.lit("code").alias("category"), F.lit("source_code").alias("type"))
    return X.file_objects(artifacts).select("id", "object_type", "source_kind", "title", "mime_type")


@register("contains_edges", "SELECT 'ku://file/pkg/m' || p_partkey || '.py' AS source_id, count(*) * 4 AS n FROM part GROUP BY p_partkey")
def contains_edges(spark, d):
    files = python_files(spark, d)
    artifacts = files.select("relative_path", F.lit("code").alias("category"), F.lit("source_code").alias("type"))
    found = pycode.first_of_each(pycode.parse_components(files)).withColumn("source_uri", F.col("relative_path"))
    return X.contains(X.file_objects(artifacts), found).groupBy("source_id").agg(F.count("*").alias("n"))


@register("catalog_jsonl", "SELECT 'KnowledgeObject' AS kind, 'c' || c_custkey AS id FROM customer UNION ALL SELECT 'KnowledgeRelationship', 'r' || c_custkey FROM customer")
def catalog_jsonl(spark, d):
    objects = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("title"), F.lit(None).cast("string").alias("content"))
    lines = catalog.catalog_lines({"objects": objects, "relationships": relationships(spark, d).select("id", "relationship_type")})
    return lines.select(F.get_json_object("value", "$.kind").alias("kind"), F.get_json_object("value", "$.data.id").alias("id"))


@register(
    "graph_validation_tallies",
    f"WITH RECURSIVE {T.supplier_sql(49.0)}, r(id, o) AS (SELECT id, id FROM nodes UNION SELECT r.id, e.target_id FROM r JOIN edges e ON r.o = e.source_id), m AS (SELECT a.id, max(a.o) AS scc FROM r a JOIN r b ON a.id = b.o AND a.o = b.id GROUP BY a.id), "
    "g AS (SELECT scc, count(*) AS members FROM m GROUP BY scc) SELECT 'error' AS level, 'cycle' AS code, count(*) AS n FROM g WHERE members > 1 OR scc IN (SELECT source_id FROM edges WHERE source_id = target_id) HAVING count(*) > 0",
)
def graph_validation(spark, d):
    return G.validate(*T.supplier_graph(spark, d, 49.0), K.relationship_types(spark)).groupBy("level", "code").agg(F.count("*").alias("n"))


@register("graph_validation_tallies_whole")
def graph_validation_whole(spark, d):
    return G.validate(T.nodes(spark, d), T.edges(spark, d), K.relationship_types(spark)).groupBy("level", "code").agg(F.count("*").alias("n"))
