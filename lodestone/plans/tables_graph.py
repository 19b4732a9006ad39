"""The driver's tables as a property graph, in Spark and as DuckDB common table expressions of the same content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _node(df: DataFrame, kind: str, key: str, title: str, tag, domain, confidence, lifecycle="published") -> DataFrame:
    c = lambda x: x if not isinstance(x, str) else F.lit(x)
    node_id = F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))
    properties = F.struct(
        F.lit(kind).alias("type"), c(domain).cast("string").alias("domain"), F.lit("demo").alias("project_id"), c(lifecycle).alias("lifecycle"), confidence.cast("double").alias("confidence"),
        F.lit(f"{kind}.parquet").alias("source"), F.array(c(tag)).alias("tags"), F.col(title).cast("string").alias("title"), F.lit(None).cast("string").alias("description"),
    )
    return df.select(node_id.alias("id"), node_id.alias("object_id"), F.lit(kind).alias("type"), F.col(title).cast("string").alias("title"), F.array(F.lit(kind), c(tag)).alias("labels"), properties.alias("properties"), F.create_map(F.lit("tag"), c(tag)).alias("metadata"))


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    t = lambda n: table(spark, folder, n)
    money = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(c) + 1000.0) / 11000.0))
    one = F.lit(1.0)
    parts = [
        _node(t("region"), "region", "r_regionkey", "r_name", F.col("r_name"), "geo", one),
        _node(t("nation"), "nation", "n_nationkey", "n_name", F.col("n_name"), "geo", one),
        _node(t("customer"), "customer", "c_custkey", "c_name", F.col("c_mktsegment"), "sales", money("c_acctbal")),
        _node(t("supplier"), "supplier", "s_suppkey", "s_name", F.lit("supply"), "purchase", money("s_acctbal")),
        _node(t("part"), "part", "p_partkey", "p_name", F.col("p_brand"), "purchase", one),
        _node(t("orders"), "order", "o_orderkey", "o_orderpriority", F.col("o_orderpriority"), "sales", one, F.when(F.col("o_orderstatus") == "O", "draft").when(F.col("o_orderstatus") == "F", "archived").otherwise("published")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _edge(df: DataFrame, kind: str, source, target, directed: bool = True, suffix=None) -> DataFrame:
    edge_id = F.concat(F.lit(f"{kind}:"), source, F.lit("->"), target, *( [F.lit("#"), suffix.cast("string")] if suffix is not None else []))
    return df.select(edge_id.alias("id"), F.lit(kind).alias("relationship_type"), source.alias("source_id"), target.alias("target_id"), F.lit(directed).alias("directed"))


def ref(kind: str, column: str):
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


def edges(spark: SparkSession, folder: str) -> DataFrame:
    t = lambda n: table(spark, folder, n)
    peers = t("customer").withColumn("peer", F.lag("c_custkey").over(Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey"))).filter("peer IS NOT NULL")
    parts = [
        _edge(t("nation"), "belongs_to", ref("nation", "n_nationkey"), ref("region", "n_regionkey")),
        _edge(t("customer"), "belongs_to", ref("customer", "c_custkey"), ref("nation", "c_nationkey")),
        _edge(t("supplier"), "belongs_to", ref("supplier", "s_suppkey"), ref("nation", "s_nationkey")),
        _edge(t("orders"), "depends_on", ref("order", "o_orderkey"), ref("customer", "o_custkey")),
        _edge(t("lineitem"), "contains", ref("order", "l_orderkey"), ref("part", "l_partkey"), suffix=F.col("l_linenumber")),
        _edge(t("lineitem").select("l_suppkey", "l_partkey").distinct(), "supports", ref("supplier", "l_suppkey"), ref("part", "l_partkey")),
        _edge(peers, "related_to", ref("customer", "peer"), ref("customer", "c_custkey"), directed=False),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def supplier_graph(spark: SparkSession, folder: str, quantity: float) -> tuple[DataFrame, DataFrame]:
    """Suppliers of consecutive lines of one order, where the line is large and discounted: a directed graph with cycles."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    steps = table(spark, folder, "lineitem").withColumn("next", F.lead("l_suppkey").over(w)).filter((F.col("next").isNotNull()) & (F.col("l_discount") >= 0.1) & (F.col("l_quantity") >= quantity))
    pairs = steps.select(ref("supplier", "l_suppkey").alias("s"), F.concat(F.lit("supplier:"), F.col("next").cast("string")).alias("t")).distinct()
    e = pairs.select(F.concat("s", F.lit("->"), "t").alias("id"), F.lit("depends_on").alias("relationship_type"), F.col("s").alias("source_id"), F.col("t").alias("target_id"), F.lit(True).alias("directed"))
    n = e.select(F.col("source_id").alias("id")).union(e.select("target_id")).distinct().select("id", F.lit("supplier").alias("type"))
    return n, e


def supplier_steps(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """All suppliers, and all steps between suppliers of consecutive lines of one order, once each."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    pairs = table(spark, folder, "lineitem").withColumn("next", F.lead("l_suppkey").over(w)).filter("next IS NOT NULL").select("l_suppkey", "next").distinct()
    return nodes(spark, folder).filter("type = 'supplier'"), _edge(pairs, "depends_on", ref("supplier", "l_suppkey"), ref("supplier", "next"))


NODES_SQL = """
nodes(id, type, title, tag, domain, lifecycle, confidence) AS (
  SELECT 'region:' || r_regionkey, 'region', r_name, r_name, 'geo', 'published', 1.0::DOUBLE FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name, n_name, 'geo', 'published', 1.0 FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name, c_mktsegment, 'sales', 'published', greatest(0.0, least(1.0, (c_acctbal + 1000.0) / 11000.0)) FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name, 'supply', 'purchase', 'published', greatest(0.0, least(1.0, (s_acctbal + 1000.0) / 11000.0)) FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'part', p_name, p_brand, 'purchase', 'published', 1.0 FROM part
  UNION ALL SELECT 'order:' || o_orderkey, 'order', o_orderpriority, o_orderpriority, 'sales', CASE o_orderstatus WHEN 'O' THEN 'draft' WHEN 'F' THEN 'archived' ELSE 'published' END, 1.0 FROM orders
)"""
EDGES_SQL = """
pairs AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem),
peers AS (SELECT c_custkey, lag(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS peer FROM customer),
raw(relationship_type, source_id, target_id, directed, suffix) AS (
  SELECT 'belongs_to', 'nation:' || n_nationkey, 'region:' || n_regionkey, true, '' FROM nation
  UNION ALL SELECT 'belongs_to', 'customer:' || c_custkey, 'nation:' || c_nationkey, true, '' FROM customer
  UNION ALL SELECT 'belongs_to', 'supplier:' || s_suppkey, 'nation:' || s_nationkey, true, '' FROM supplier
  UNION ALL SELECT 'depends_on', 'order:' || o_orderkey, 'customer:' || o_custkey, true, '' FROM orders
  UNION ALL SELECT 'contains', 'order:' || l_orderkey, 'part:' || l_partkey, true, '#' || l_linenumber FROM lineitem
  UNION ALL SELECT 'supports', 'supplier:' || l_suppkey, 'part:' || l_partkey, true, '' FROM pairs
  UNION ALL SELECT 'related_to', 'customer:' || peer, 'customer:' || c_custkey, false, '' FROM peers WHERE peer IS NOT NULL
),
edges AS (SELECT relationship_type || ':' || source_id || '->' || target_id || suffix AS id, relationship_type, source_id, target_id, directed FROM raw)"""
STEPS_SQL = """
steps AS (SELECT source_id AS s, target_id AS t FROM edges UNION ALL SELECT target_id, source_id FROM edges WHERE NOT directed)"""


def supplier_sql(quantity: float) -> str:
    return f"""
walked AS (SELECT l_suppkey, l_discount, l_quantity, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS nxt FROM lineitem),
edges AS (SELECT DISTINCT 'supplier:' || l_suppkey AS source_id, 'supplier:' || nxt AS target_id FROM walked WHERE nxt IS NOT NULL AND l_discount >= 0.1 AND l_quantity >= {quantity}),
nodes AS (SELECT source_id AS id FROM edges UNION SELECT target_id FROM edges)"""
