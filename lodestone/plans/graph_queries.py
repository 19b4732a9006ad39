"""Graph queries over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import graph as G
from lodestone.plans import tables_graph as T

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _graph(spark, d):
    return T.nodes(spark, d), T.edges(spark, d)


N, E = T.NODES_SQL, T.EDGES_SQL
ENDS = "SELECT source_id FROM edges WHERE relationship_type = '{0}' UNION SELECT target_id FROM edges WHERE relationship_type = '{0}'"


@register("graph_query_conjunctive", f"WITH {N}, {E} SELECT id FROM nodes WHERE type = 'customer' AND tag = 'BUILDING' AND confidence >= 0.5 AND id IN ({ENDS.format('belongs_to')}) ORDER BY id LIMIT 10")
def conjunctive(spark, d):
    n, e = _graph(spark, d)
    return G.query_nodes(G.GraphQuery(node_type="customer", tags=("BUILDING",), confidence_min=0.5, relationship_type="belongs_to", limit=10), n, e)


@register("graph_query_tags", f"WITH {N} SELECT id FROM nodes WHERE (tag = 'BUILDING' OR type = 'BUILDING') AND domain = 'sales' AND type = 'customer'")
def tags(spark, d):
    n, e = _graph(spark, d)
    return G.query_nodes(G.GraphQuery(tags=("customer", "BUILDING"), domain="sales"), n, e)


@register("graph_query_confidence", f"WITH {N} SELECT id FROM nodes WHERE confidence BETWEEN 0.25 AND 0.75")
def confidence(spark, d):
    n, e = _graph(spark, d)
    return G.query_nodes(G.GraphQuery(confidence_min=0.25, confidence_max=0.75), n, e)


@register("graph_query_metadata", f"WITH {N} SELECT id FROM nodes WHERE tag = '1-URGENT' AND lifecycle = 'draft'")
def metadata(spark, d):
    n, e = _graph(spark, d)
    return G.query_nodes(G.GraphQuery(metadata={"tag": "1-URGENT"}, lifecycle="draft", project_id="demo", source="order.parquet"), n, e)


@register("graph_query_relationship", f"WITH {E} {ENDS.format('related_to')}".replace("SELECT source_id FROM", "SELECT source_id AS id FROM", 1))
def relationship(spark, d):
    n, e = _graph(spark, d)
    return G.query_nodes(G.GraphQuery(relationship_type="related_to"), n, e)


@register("graph_query_edge_type", f"WITH {E} SELECT id FROM edges WHERE relationship_type = 'supports'")
def edge_type(spark, d):
    return G.query_edges(G.GraphQuery(edge_type="supports"), T.edges(spark, d))


@register("graph_query_edge_only_nodes", f"WITH {N} SELECT id FROM nodes WHERE false")
def edge_only(spark, d):
    n, e = _graph(spark, d)
    return G.query_nodes(G.GraphQuery(edge_type="supports"), n, e)


@register("graph_query_topk", f"WITH {N} SELECT id FROM nodes ORDER BY id LIMIT 25")
def topk(spark, d):
    n, e = _graph(spark, d)
    return G.query_nodes(G.GraphQuery(limit=25), n, e)


@register("node_type_histogram", f"WITH {N} SELECT type, count(*) AS n FROM nodes GROUP BY type")
def node_histogram(spark, d):
    return G.type_histogram(T.nodes(spark, d))


@register("edge_type_histogram", f"WITH {E} SELECT relationship_type, count(*) AS n FROM edges GROUP BY relationship_type")
def edge_histogram(spark, d):
    return G.edge_histogram(T.edges(spark, d))


@register(
    "degree_stats",
    f"WITH {N}, {E}, a AS (SELECT count(*) AS node_count FROM nodes), b AS (SELECT count(*) AS edge_count, sum(CASE WHEN directed THEN 1 ELSE 2 END)::BIGINT AS total_degree FROM edges) "
    "SELECT node_count, edge_count, total_degree, total_degree::DOUBLE / node_count AS average_in_degree, total_degree::DOUBLE / node_count AS average_out_degree, edge_count::DOUBLE / (node_count::DOUBLE * (node_count - 1)::DOUBLE) AS density FROM a, b",
)
def degree_stats(spark, d):
    return G.degree_stats(*_graph(spark, d))


@register("orphan_nodes", f"WITH {N}, {E} SELECT id FROM nodes WHERE id NOT IN (SELECT source_id FROM edges UNION SELECT target_id FROM edges)")
def orphans(spark, d):
    return G.orphans(*_graph(spark, d))


@register(
    "duplicate_edges",
    f"WITH {E}, k AS (SELECT CASE WHEN directed THEN source_id ELSE least(source_id, target_id) END AS source_id, CASE WHEN directed THEN target_id ELSE greatest(source_id, target_id) END AS target_id, relationship_type, id FROM edges) "
    "SELECT source_id, target_id, relationship_type, count(*) AS n, string_agg(id, '|' ORDER BY id) AS ids FROM k GROUP BY ALL HAVING count(*) > 1",
)
def duplicates(spark, d):
    return G.duplicate_edges(T.edges(spark, d)).withColumn("ids", F.array_join("edge_ids", "|")).drop("edge_ids")


@register(
    "broken_references",
    f"WITH {N}, {E}, kept AS (SELECT id FROM nodes WHERE NOT (type = 'customer' AND split_part(id, ':', 2)::BIGINT % 50 = 0)) "
    "SELECT 'error' AS level, 'broken_reference' AS code, 'edge source does not exist: ' || source_id AS message, id AS source_ref FROM edges WHERE source_id NOT IN (SELECT id FROM kept) "
    "UNION ALL SELECT 'error', 'broken_reference', 'edge target does not exist: ' || target_id, id FROM edges WHERE target_id NOT IN (SELECT id FROM kept)",
)
def broken(spark, d):
    n, e = _graph(spark, d)
    number = F.split_part("id", F.lit(":"), F.lit(2)).cast("bigint")
    return G.broken_references(n.filter(F.when(F.col("type") == "customer", number % 50 != 0).otherwise(True)), e)


@register(
    "relationship_typing",
    f"WITH {N}, {E}, t(relationship_type, f, g) AS (VALUES ('belongs_to', ['customer', 'nation'], ['nation', 'region']), ('contains', ['order'], ['part', 'order']), ('depends_on', NULL, ['order']), ('related_to', NULL, NULL)), "
    "k AS (SELECT e.*, t.relationship_type IS NULL AS unknown, f, g, s.type AS st, u.type AS ut FROM edges e LEFT JOIN t USING (relationship_type) JOIN nodes s ON s.id = source_id JOIN nodes u ON u.id = target_id) "
    "SELECT 'error' AS level, 'invalid_relationship_type' AS code, 'unknown relationship type: ' || relationship_type AS message, id AS source_ref FROM k WHERE unknown "
    "UNION ALL SELECT 'error', 'invalid_relationship_source', relationship_type || ' does not allow ' || st, id FROM k WHERE NOT list_contains(f, st) "
    "UNION ALL SELECT 'error', 'invalid_relationship_target', relationship_type || ' does not allow ' || ut, id FROM k WHERE NOT list_contains(g, ut)",
)
def typing(spark, d):
    types = spark.createDataFrame([("belongs_to", ["customer", "nation"], ["nation", "region"]), ("contains", ["order"], ["part", "order"]), ("depends_on", None, ["order"]), ("related_to", None, None)], "id string, allowed_from_types array<string>, allowed_to_types array<string>")
    return G.relationship_typing(*_graph(spark, d), types)


START = "customer:1"


@register("neighbors_both", f"WITH {E} SELECT DISTINCT CASE WHEN source_id = '{START}' THEN target_id ELSE source_id END AS id FROM edges WHERE source_id = '{START}' OR target_id = '{START}'")
def neighbors(spark, d):
    return G.neighbors(T.edges(spark, d), START)


def _walk_sql(edges: str, depth: int, start: str, with_start: bool = True) -> str:
    return f"WITH RECURSIVE {E}, moves AS ({edges}), w(id, distance) AS (SELECT '{start}', 0 UNION SELECT t, distance + 1 FROM w JOIN moves ON s = id WHERE distance < {depth}) SELECT id, min(distance)::INTEGER AS distance FROM w {'' if with_start else f'''WHERE id <> '{start}' '''}GROUP BY id"


OUT = "SELECT source_id AS s, target_id AS t FROM edges UNION ALL SELECT target_id, source_id FROM edges WHERE NOT directed"
IN = "SELECT target_id AS s, source_id AS t FROM edges UNION ALL SELECT source_id, target_id FROM edges WHERE NOT directed"


@register("bfs_distances", _walk_sql(OUT, 3, START))
def bfs(spark, d):
    return G.bfs(*_graph(spark, d), START, "outgoing", 3).select("id", "distance")


@register("descendants_depth_k", _walk_sql(OUT, 2, "order:1", False))
def descendants(spark, d):
    return G.descendants(*_graph(spark, d), "order:1", 2)


@register("ancestors_depth_k", _walk_sql(IN, 2, "nation:3", False))
def ancestors(spark, d):
    return G.ancestors(*_graph(spark, d), "nation:3", 2)


@register("neighborhood_radius", _walk_sql(OUT + " UNION ALL " + IN, 2, "supplier:2", False))
def neighborhood(spark, d):
    return G.neighborhood(*_graph(spark, d), "supplier:2", 2)


@register("dependency_walk", f"WITH RECURSIVE {E}, moves AS (SELECT source_id AS s, target_id AS t FROM edges WHERE relationship_type IN ('depends_on', 'belongs_to')), w(id, distance) AS (SELECT 'order:1', 0 UNION SELECT t, distance + 1 FROM w JOIN moves ON s = id WHERE distance < 9) SELECT id, min(distance)::INTEGER AS distance FROM w GROUP BY id")
def dependency(spark, d):
    n, e = _graph(spark, d)
    return G.traverse(G.Traversal("order:1", "dependency", edge_types=("depends_on", "belongs_to"), max_depth=9), n, e).select("id", "distance")


@register("reverse_dependency_walk", f"WITH RECURSIVE {E}, moves AS (SELECT target_id AS s, source_id AS t FROM edges WHERE relationship_type IN ('depends_on', 'belongs_to')), w(id, distance) AS (SELECT 'nation:5', 0 UNION SELECT t, distance + 1 FROM w JOIN moves ON s = id WHERE distance < 9) SELECT id, min(distance)::INTEGER AS distance FROM w GROUP BY id")
def reverse_dependency(spark, d):
    n, e = _graph(spark, d)
    return G.traverse(G.Traversal("nation:5", "reverse_dependency", edge_types=("depends_on", "belongs_to"), max_depth=9), n, e).select("id", "distance")


@register("shortest_path_length", f"WITH RECURSIVE {E}, moves AS (SELECT DISTINCT source_id AS s, target_id AS t FROM edges WHERE directed), w(id, distance) AS (SELECT 'order:1', 0 UNION SELECT t, distance + 1 FROM w JOIN moves ON s = id WHERE distance < 6) SELECT (min(distance) + 1)::BIGINT AS hops FROM w WHERE id = 'region:' || (SELECT n_regionkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderkey = 1)")
def shortest(spark, d):
    n, e = _graph(spark, d)
    end = T.table(spark, d, "orders").filter("o_orderkey = 1").join(T.table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(T.table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).first()
    path = G.shortest_path(n, e, "order:1", f"region:{end.n_regionkey}")
    return spark.createDataFrame([(len(path),)], "hops bigint")


@register("dfs_order")
def dfs(spark, d):
    n, e = T.supplier_graph(spark, d, 49.0)
    return G.dfs(n, e, n.orderBy("id").first().id if n.take(1) else "")


def _closure(q: float) -> str:
    return f"WITH RECURSIVE {T.supplier_sql(q)}, "


@register("connected_components", _closure(50.0) + "b AS (SELECT source_id AS s, target_id AS t FROM edges UNION SELECT target_id, source_id FROM edges), r(id, o) AS (SELECT id, id FROM nodes UNION SELECT r.id, b.t FROM r JOIN b ON r.o = b.s) SELECT id, min(o) AS component FROM r GROUP BY id")
def components(spark, d):
    return G.components(*T.supplier_graph(spark, d, 50.0))


SCC = "r(id, o) AS (SELECT id, id FROM nodes UNION SELECT r.id, e.target_id FROM r JOIN edges e ON r.o = e.source_id), m AS (SELECT a.id, max(a.o) AS scc FROM r a JOIN r b ON a.id = b.o AND a.o = b.id GROUP BY a.id) "


@register("strong_components", _closure(48.0) + SCC + "SELECT id, scc FROM m")
def strong(spark, d):
    return G.strong_components(*T.supplier_graph(spark, d, 48.0))


@register("strong_components_distributed", _closure(49.0) + SCC + "SELECT id, scc FROM m")
def strong_distributed(spark, d):
    return G.strong_components(*T.supplier_graph(spark, d, 49.0), driver_edges=0)


@register("cycle_count", _closure(48.0) + SCC + ", g AS (SELECT scc, count(*) AS members FROM m GROUP BY scc) SELECT scc, members FROM g WHERE members > 1 OR scc IN (SELECT source_id FROM edges WHERE source_id = target_id)")
def cycle_count(spark, d):
    return G.cycles(*T.supplier_graph(spark, d, 48.0))


# The queries above are bound by what their SQL can close over; these have no thresholds and no SQL, see tests/test_whole_graph.py.


@register("dfs_order_whole")
def dfs_whole(spark, d):
    return G.dfs(*_graph(spark, d), START)


@register("connected_components_whole")
def components_whole(spark, d):
    return G.components(*_graph(spark, d))


@register("strong_components_whole")
def strong_whole(spark, d):
    return G.strong_components(*T.supplier_steps(spark, d))


@register("strong_components_distributed_whole")
def strong_distributed_whole(spark, d):
    return G.strong_components(*T.supplier_steps(spark, d), driver_edges=0)


@register("cycle_count_whole")
def cycle_count_whole(spark, d):
    return G.cycles(*T.supplier_steps(spark, d))


@register(
    "export_dot_lines",
    f"WITH {N}, {E} SELECT 0 AS part, 'digraph G {{' AS line UNION ALL SELECT 3, '}}' UNION ALL SELECT 1, '  \"' || id || '\" [label=\"' || left(title, 80) || '\"];' FROM nodes UNION ALL SELECT 2, '  \"' || source_id || '\" -> \"' || target_id || '\" [label=\"' || relationship_type || '\"];' FROM edges",
)
def dot(spark, d):
    return G.dot_lines(*_graph(spark, d))


@register(
    "export_cypher_lines",
    f"WITH {N}, {E} SELECT 1 AS part, 'MERGE (n:Node {{id: \"' || id || '\"}}) SET n.type = \"' || type || '\", n.title = \"' || title || '\";' AS line FROM nodes "
    "UNION ALL SELECT 2, 'MATCH (a {id: \"' || source_id || '\"}), (b {id: \"' || target_id || '\"}) MERGE (a)-[:' || relationship_type || ']->(b);' FROM edges",
)
def cypher(spark, d):
    return G.cypher_lines(*_graph(spark, d))


@register("export_jsonl_records", f"WITH {N}, {E} SELECT 'node' AS kind, id FROM nodes UNION ALL SELECT 'edge', id FROM edges")
def jsonl(spark, d):
    lines = G.jsonl_lines(*_graph(spark, d))
    return lines.select(F.get_json_object("line", "$.kind").alias("kind"), F.get_json_object("line", "$.data.id").alias("id"))
