"""The property graph: building, querying, walking, measuring, validating and writing it out.

A graph is two DataFrames: ``nodes`` (id, type, title, labels, ...) and ``edges`` (id, relationship_type, source_id, target_id,
directed, seq, ...), see schemas.NODES and schemas.EDGES; functions name the columns that they need.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import cypher_string, dot_label, dot_quote
from lodestone.operators.components import connected_components
from lodestone.operators.keyed import dimension
from lodestone.session import cut

# ---- building -----------------------------------------------------------------------------------------------------


def nodes_of(objects: DataFrame) -> DataFrame:
    """Nodes of knowledge objects: labels are the type, the domain tags and the tags; properties.tags are tags, then domain tags."""
    own = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    properties = F.struct(
        F.col("type"), F.col("metadata.domain").alias("domain"), F.col("metadata.project_id").alias("project_id"), F.col("lifecycle.state").alias("lifecycle"), F.col("confidence.value").alias("confidence"),
        F.try_element_at("sources", F.lit(1)).getField("uri").alias("source"), F.concat(own("tags"), own("domain_tags")).alias("tags"), F.col("title"), F.col("description"),
    )
    return objects.select("id", F.col("id").alias("object_id"), "type", "title", F.concat(F.array("type"), own("domain_tags"), own("tags")).alias("labels"), properties.alias("properties"), F.col("metadata.custom").alias("metadata"))


def edges_of(relationships: DataFrame, relationship_types: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Edges of relationships between objects; directed as their type says (``relationship_types`` first, then ``known``), else true."""
    here = relationship_types.select(F.col("id").alias("relationship_type"), F.col("directed").alias("__d1"))
    there = (known if known is not None else relationship_types).select(F.col("id").alias("relationship_type"), F.col("directed").alias("__d2"))
    df = relationships.filter("from_ref.kind = 'knowledge_object' AND to_ref.kind = 'knowledge_object'")
    df = df.join(dimension(here.dropDuplicates(["relationship_type"])), "relationship_type", "left").join(dimension(there.dropDuplicates(["relationship_type"])), "relationship_type", "left")
    properties = F.struct(F.col("confidence.value").alias("confidence"), F.coalesce(F.size("evidence"), F.lit(0)).cast("long").alias("evidence_count"), F.lit(False).alias("synthetic"))
    return df.select("id", "relationship_type", F.col("from_ref.ref").alias("source_id"), F.col("to_ref.ref").alias("target_id"), F.coalesce("__d1", "__d2", F.lit(True)).alias("directed"), properties.alias("properties"), F.col("id").alias("relationship_id"))


def reference_edges(objects: DataFrame) -> DataFrame:
    """One synthetic, directed ``references`` edge per pair of an object and an object that it refers to."""
    pairs = objects.select(F.col("id").alias("source_id"), F.explode("references").alias("r")).filter("r.kind = 'knowledge_object'").select("source_id", F.col("r.ref").alias("target_id")).distinct()
    properties = F.struct(F.lit(None).cast("double").alias("confidence"), F.lit(0).cast("long").alias("evidence_count"), F.lit(True).alias("synthetic"))
    return pairs.select(F.concat(F.lit("ref:"), "source_id", F.lit("->"), "target_id").alias("id"), F.lit("references").alias("relationship_type"), "source_id", "target_id", F.lit(True).alias("directed"), properties.alias("properties"), F.lit(None).cast("string").alias("relationship_id"))


def build(objects: DataFrame, relationships: DataFrame, relationship_types: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    return nodes_of(objects), edges_of(relationships, relationship_types, known).unionByName(reference_edges(objects))


# ---- queries --------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class GraphQuery:
    """All criteria must hold; a query with an edge type alone finds no nodes, and one without any criterion all nodes. 0 is no limit."""

    node_type: str | None = None
    tags: tuple = ()
    domain: str | None = None
    source: str | None = None
    lifecycle: str | None = None
    project_id: str | None = None
    relationship_type: str | None = None
    edge_type: str | None = None
    metadata: dict = field(default_factory=dict)
    confidence_min: float | None = None
    confidence_max: float | None = None
    limit: int | None = None


def _criteria(q: GraphQuery) -> Column | None:
    found = [F.col("type") == q.node_type] if q.node_type else []
    found += [F.array_contains("labels", t) for t in q.tags]
    found += [F.col(f"properties.{k}") == v for k, v in (("domain", q.domain), ("source", q.source), ("lifecycle", q.lifecycle), ("project_id", q.project_id)) if v]
    found += [F.try_element_at("metadata", F.lit(k)) == v for k, v in q.metadata.items()]
    if q.confidence_min is not None:
        found.append(F.col("properties.confidence") >= q.confidence_min)
    if q.confidence_max is not None:
        found.append(F.col("properties.confidence") <= q.confidence_max)
    condition = None
    for c in found:
        condition = c if condition is None else condition & c
    return condition


def query_nodes(q: GraphQuery, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) of the nodes that fit; with a limit, the first ones by id. One filter, and one aggregation by id for the relationship type."""
    condition = _criteria(q)
    if condition is None and not q.relationship_type and q.edge_type:
        return nodes.select("id").limit(0)
    found = nodes if condition is None else nodes.filter(condition)
    if q.relationship_type:
        typed = edges.filter(F.col("relationship_type") == q.relationship_type)
        ends = typed.select(F.col("source_id").alias("id")).union(typed.select("target_id"))
        # a semi-join as one aggregation: the edges shrink to their distinct ends before the shuffle, and no side is planned once per branch of a union
        both = found.select("id", F.lit(True).alias("node"), F.lit(False).alias("end")).union(ends.select("id", F.lit(False), F.lit(True)))
        found = both.groupBy("id").agg(F.bool_or("node").alias("node"), F.bool_or("end").alias("end")).filter("node AND end")
    found = found.select("id")
    return found.orderBy("id").limit(q.limit) if q.limit else found


def query_edges(q: GraphQuery, edges: DataFrame) -> DataFrame:
    """(id) of the edges of the edge type, else of the relationship type, else none; neither nodes nor the limit restrict them."""
    kind = q.edge_type or q.relationship_type
    return edges.filter(F.col("relationship_type") == kind).select("id") if kind else edges.select("id").limit(0)


# ---- walks ----------------------------------------------------------------------------------------------------------

DIRECTIONS = ("outgoing", "incoming", "both")


def adjacency(edges: DataFrame, direction: str = "outgoing", edge_types: list[str] | None = None) -> DataFrame:
    """(node, next, turn, edge_seq): steps that may be taken; undirected edges may be taken both ways, outgoing steps come first."""
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}")
    df = edges.filter(F.col("relationship_type").isin(edge_types)) if edge_types else edges
    seq = F.col("seq") if "seq" in df.columns else F.xxhash64("id")
    step = lambda a, b, turn, rows: rows.select(F.col(a).alias("node"), F.col(b).alias("next"), F.lit(turn).alias("turn"), seq.alias("edge_seq"))
    out = step("source_id", "target_id", 0, df).union(step("target_id", "source_id", 0, df.filter("NOT directed")))
    into = step("target_id", "source_id", 1, df).union(step("source_id", "target_id", 1, df.filter("NOT directed")))
    return {"outgoing": out, "incoming": into, "both": out.union(into)}[direction]


def neighbors(edges: DataFrame, node: str, direction: str = "both", edge_types: list[str] | None = None) -> DataFrame:
    """(id) of the ends of edges at ``node``, itself if it has a loop; ends need not be nodes."""
    return adjacency(edges, direction, edge_types).filter(F.col("node") == node).select(F.col("next").alias("id")).distinct()


def bfs(nodes: DataFrame, edges: DataFrame, start: str, direction: str = "outgoing", max_depth: int | None = None, edge_types: list[str] | None = None, target: str | None = None, ordered: bool = True) -> DataFrame:
    """(id, distance, visit, parent): breadth-first from ``start``; empty if it is no node.

    ``visit`` counts in the order of a queue: by the parent's visit, outgoing before incoming, then the edge's seq. Each level is a join of the
    frontier with the steps, an anti-join with what was seen, and one minimum per node; levels are checkpointed. The order within a
    level is a global sort of that level's new nodes; without ``ordered`` there is none, and ``visit`` is 0. Stops once ``target`` is reached.
    """
    spark = nodes.sparkSession
    steps = cut(adjacency(edges, direction, edge_types))
    schema = "id string, distance int, visit bigint, parent string"
    here = bool(nodes.filter(F.col("id") == start).take(1))
    level = spark.createDataFrame([(start, 0, 0, None)] if here else [], schema)
    seen, count, depth = level, 1, 0
    while here and (max_depth is None or depth < max_depth):
        depth += 1
        reached = level.join(steps, F.col("id") == F.col("node")).select(F.col("next").alias("n"), F.struct("visit", "turn", "edge_seq", F.col("id").alias("parent")).alias("by"))
        fresh = reached.join(seen.select(F.col("id").alias("n")), "n", "left_anti").groupBy("n").agg(F.min("by").alias("by"))
        order = Window.orderBy("by.visit", "by.turn", "by.edge_seq", "n")
        visit = (F.row_number().over(order) + count - 1).cast("long") if ordered else F.lit(0).cast("long")
        level = cut(fresh.select(F.col("n").alias("id"), F.lit(depth).alias("distance"), visit.alias("visit"), F.col("by.parent").alias("parent")))
        found = level.agg(F.count("*").alias("c"), F.coalesce(F.max(F.col("id") == target), F.lit(False)).alias("hit")).first() if target else level.agg(F.count("*").alias("c"), F.lit(False).alias("hit")).first()
        if not found.c:
            break
        count += found.c
        seen = cut(seen.union(level)) if depth % 4 == 0 else seen.union(level)
        if found.hit:
            break
    return seen


def reachable(nodes: DataFrame, edges: DataFrame, start: str, direction: str, max_depth: int | None = None) -> DataFrame:
    """(id, distance) of what is reachable within ``max_depth`` steps, without ``start``."""
    return bfs(nodes, edges, start, direction, max_depth, ordered=False).filter(F.col("id") != start).select("id", "distance")


def descendants(nodes: DataFrame, edges: DataFrame, start: str, max_depth: int | None = None) -> DataFrame:
    return reachable(nodes, edges, start, "outgoing", max_depth)


def ancestors(nodes: DataFrame, edges: DataFrame, start: str, max_depth: int | None = None) -> DataFrame:
    return reachable(nodes, edges, start, "incoming", max_depth)


def neighborhood(nodes: DataFrame, edges: DataFrame, start: str, radius: int = 1, legacy: bool = False) -> DataFrame:
    """Within ``radius`` steps in both directions; ``legacy`` follows incoming edges only."""
    return reachable(nodes, edges, start, "incoming" if legacy else "both", radius)


def shortest_path(nodes: DataFrame, edges: DataFrame, start: str, end: str, edge_types: list[str] | None = None) -> list[str]:
    """Node ids along outgoing, directed edges, first found first; empty if there is none, one node if start is end."""
    ends = {r.id for r in nodes.filter(F.col("id").isin(start, end)).select("id").collect()}
    if not {start, end} <= ends:
        return []
    if start == end:
        return [start]
    seen = bfs(nodes, edges.filter("directed"), start, "outgoing", None, edge_types, target=end)
    path, at = [], end
    while at is not None:  # one point lookup per step of the path
        row = seen.filter(F.col("id") == at).select("parent").first()
        if row is None:
            return []
        path.append(at)
        at = row.parent
    return path[::-1]


def has_path(nodes: DataFrame, edges: DataFrame, start: str, end: str) -> bool:
    """Whether a path exists; from a node to itself always."""
    return bool(shortest_path(nodes, edges, start, end))


#: Ids that are broadcast at most, about 30 MB as a hash table.
BROADCAST_IDS = 200_000


def _few(ids: DataFrame, n: int) -> DataFrame:
    """``ids`` (materialised, ``n`` rows) for a join: broadcast if they are few, shuffled otherwise."""
    return F.broadcast(ids) if n <= BROADCAST_IDS else ids


def closure(nodes: DataFrame, edges: DataFrame, start: str, direction: str = "outgoing", edge_types: list[str] | None = None) -> tuple[DataFrame, int]:
    """(id) of all that is reachable from ``start``, itself included, and their number; empty if it is no node.

    Nodes that steps both ways connect are reached together: their components are found in logarithmic rounds, however long a chain of
    them is. Then each round takes one directed step from all that the last one reached, and adds the whole components of what it finds.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}")
    spark = nodes.sparkSession
    level = spark.createDataFrame([(start,)] if nodes.filter(F.col("id") == start).take(1) else [], "id string")
    if not level.take(1):
        return level, 0
    used = edges.filter(F.col("relationship_type").isin(edge_types)) if edge_types else edges
    same = cut(connected_components(used if direction == "both" else used.filter("NOT directed"), "source_id", "target_id"))
    steps = adjacency(used.filter("NOT directed <=> false"), direction).select("node", F.col("next").alias("id")).filter("id IS NOT NULL")

    def completed(ids: DataFrame) -> tuple[DataFrame, int]:
        """``ids`` with their components; where a node is new, its whole component is."""
        ids = cut(ids)
        if not (n := ids.count()):
            return ids, 0
        found = cut(same.join(_few(ids, n), F.col("node") == F.col("id")).select(F.col("component").alias("c")).distinct())
        both = cut(ids.union(same.join(_few(found, found.count()), F.col("component") == F.col("c")).select("node")).distinct())
        return both, both.count()

    level, n = completed(level)
    seen, total = level, n
    while n and direction != "both":
        reached = steps.join(_few(level.select(F.col("id").alias("node")), n), "node", "left_semi").select("id").distinct()
        level, n = completed(reached.join(_few(seen, total), "id", "left_anti"))
        seen, total = cut(seen.union(level)), total + n
    return seen, total


#: Edges that a depth-first walk may collect; its order is sequential by nature.
DFS_EDGES = 200_000


def dfs(nodes: DataFrame, edges: DataFrame, start: str, direction: str = "outgoing", max_depth: int | None = None, edge_types: list[str] | None = None) -> DataFrame:
    """(id, distance, visit) in preorder; distance is the depth at the first visit, so max_depth can hide nodes that a shorter path reaches.

    The steps among what is reachable are collected, at most DFS_EDGES of them; a larger walk raises.
    """
    spark = nodes.sparkSession
    if max_depth is None:
        near, n = closure(nodes, edges, start, direction, edge_types)
    else:
        near = cut(bfs(nodes, edges, start, direction, max_depth, edge_types, ordered=False).select("id"))
        n = near.count()
    near = _few(near.select(F.col("id").alias("node")), n)
    rows = adjacency(edges, direction, edge_types).join(near, "node", "left_semi").orderBy("node", "turn", "edge_seq", "next").limit(DFS_EDGES + 1).collect()
    if len(rows) > DFS_EDGES:
        raise ValueError(f"a depth-first walk is limited to {DFS_EDGES} steps; use bfs")
    after: dict = {}
    for r in rows:
        after.setdefault(r.node, []).append(r.next)
    order, depth_of = [], {}
    stack = [(start, 0)] if n else []
    while stack:
        node, depth = stack.pop()
        if node in depth_of:
            continue
        depth_of[node] = depth
        order.append(node)
        if max_depth is None or depth < max_depth:
            stack.extend((n, depth + 1) for n in reversed(after.get(node, [])) if n not in depth_of)
    return spark.createDataFrame([(n, depth_of[n], i) for i, n in enumerate(order)], "id string, distance int, visit bigint")


@dataclass(frozen=True)
class Traversal:
    start: str
    strategy: str = "bfs"
    target: str | None = None
    direction: str = "outgoing"
    max_depth: int | None = None
    edge_types: tuple = ()


def traverse(t: Traversal, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, distance, visit) by strategy: bfs, dfs, shortest (distances null), dependency (bfs outgoing), reverse_dependency (bfs incoming)."""
    types = list(t.edge_types) or None
    if t.strategy in ("bfs", "dependency", "reverse_dependency"):
        direction = {"bfs": t.direction, "dependency": "outgoing", "reverse_dependency": "incoming"}[t.strategy]
        return bfs(nodes, edges, t.start, direction, t.max_depth, types).select("id", "distance", "visit")
    if t.strategy == "dfs":
        return dfs(nodes, edges, t.start, t.direction, t.max_depth, types)
    if t.strategy == "shortest":
        if t.target is None:
            raise ValueError("shortest needs a target")
        path = shortest_path(nodes, edges, t.start, t.target, types)
        return nodes.sparkSession.createDataFrame([(n, None, i) for i, n in enumerate(path)], "id string, distance int, visit bigint")
    raise ValueError(f"unknown strategy {t.strategy}")


# ---- components and cycles ------------------------------------------------------------------------------------------


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) of every node, edges taken both ways; dangling ends may bridge nodes but are no members."""
    found = connected_components(edges, "source_id", "target_id")
    return nodes.select("id").distinct().join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def strong_components(nodes: DataFrame, edges: DataFrame, driver_edges: int = 200_000) -> DataFrame:
    """(id, scc) of every node over directed edges between nodes; scc is the largest id of the component.

    Nodes without incoming or outgoing edges are peeled off in rounds. What is left is solved on the driver up to ``driver_edges`` edges; beyond
    that by colouring: the largest id that reaches a node is its colour, and what reaches the colour's own node within the colour is a component.
    """
    spark = nodes.sparkSession
    ids = nodes.select("id").distinct()
    live = edges.filter("directed AND source_id <> target_id").select(F.col("source_id").alias("s"), F.col("target_id").alias("t")).distinct()
    live = cut(live.join(ids.select(F.col("id").alias("s")), "s", "left_semi").join(ids.select(F.col("id").alias("t")), "t", "left_semi").select("s", "t"))
    done = spark.createDataFrame([], "id string, scc string")
    while True:
        n = live.count()
        while n:  # peel
            inner = live.select(F.col("s").alias("id")).intersect(live.select("t"))
            kept = cut(live.join(inner.select(F.col("id").alias("s")), "s", "left_semi").join(inner.select(F.col("id").alias("t")), "t", "left_semi").select("s", "t"))
            m = kept.count()
            live = kept
            if m == n:
                break
            n = m
        if not n:
            break
        if n <= driver_edges:
            rows = _tarjan([(r.s, r.t) for r in live.collect()])
            done = done.union(spark.createDataFrame(rows, "id string, scc string"))
            break
        colour = cut(live.select(F.col("s").alias("id")).union(live.select("t")).distinct().withColumn("c", F.col("id")))
        while True:
            pushed = live.join(colour, F.col("s") == F.col("id")).groupBy("t").agg(F.max("c").alias("p"))
            moved = cut(colour.join(pushed, F.col("id") == F.col("t"), "left").select("id", F.greatest("c", F.coalesce("p", "c")).alias("c"), (F.coalesce("p", "c") > F.col("c")).alias("changed")))
            colour = moved.select("id", "c")
            if not moved.filter("changed").take(1):
                break
        inside = cut(live.join(colour.select(F.col("id").alias("s"), F.col("c").alias("cs")), "s").join(colour.select(F.col("id").alias("t"), F.col("c").alias("ct")), "t").filter("cs = ct").select("s", "t"))
        found = colour.filter("id = c").select("id", F.col("c").alias("scc"))
        frontier = found
        while True:
            back = inside.join(frontier.select(F.col("id").alias("t"), "scc"), "t").select(F.col("s").alias("id"), "scc").distinct()
            frontier = cut(back.join(found, ["id", "scc"], "left_anti"))
            if not frontier.take(1):
                break
            found = cut(found.union(frontier))
        done = cut(done.union(found))
        gone = found.select("id")
        live = cut(live.join(gone.select(F.col("id").alias("s")), "s", "left_anti").join(gone.select(F.col("id").alias("t")), "t", "left_anti").select("s", "t"))
    return ids.join(done, "id", "left").select("id", F.coalesce("scc", "id").alias("scc"))


def _tarjan(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(node, largest node of its strong component), without recursion."""
    after: dict = {}
    for s, t in pairs:
        after.setdefault(s, []).append(t)
        after.setdefault(t, [])
    index, low, on, stack, out = {}, {}, set(), [], []
    for root in after:
        if root in index:
            continue
        work = [(root, iter(after[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            node, rest = work[-1]
            for n in rest:
                if n not in index:
                    index[n] = low[n] = len(index)
                    stack.append(n)
                    on.add(n)
                    work.append((n, iter(after[n])))
                    break
                if n in on:
                    low[node] = min(low[node], index[n])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    members = []
                    while True:
                        m = stack.pop()
                        on.discard(m)
                        members.append(m)
                        if m == node:
                            break
                    out += [(m, max(members)) for m in members]
    return out


def cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(scc, members): strong components of more than one node, and nodes with a directed edge to themselves."""
    scc = cut(strong_components(nodes, edges))
    large = scc.groupBy("scc").agg(F.count("*").alias("members")).filter("members > 1")
    loops = edges.filter("directed AND source_id = target_id").select(F.col("source_id").alias("id")).distinct()
    alone = scc.join(loops, "id", "left_semi").join(large.select("scc"), "scc", "left_anti").select("scc", F.lit(1).cast("long").alias("members"))
    return large.unionByName(alone)


# ---- statistics -----------------------------------------------------------------------------------------------------


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) of nodes at no edge. One aggregation by id with map-side combining: edges shrink to their distinct ends before the shuffle."""
    marked = lambda df, c, node: df.select(F.col(c).alias("id"), F.lit(node).alias("node"))
    both = marked(nodes, "id", True).union(marked(edges, "source_id", False)).union(marked(edges, "target_id", False))
    return both.groupBy("id").agg(F.bool_and("node").alias("lonely")).filter("lonely").select("id")


def type_histogram(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("type").agg(F.count("*").alias("n"))


def edge_histogram(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relationship_type").agg(F.count("*").alias("n"))


def degree_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: node_count, edge_count, in- and out-degree (undirected edges count twice in both), averages and density; 0 where there is nothing to divide by."""
    n = nodes.agg(F.count("*").alias("node_count"))
    e = edges.agg(F.count("*").alias("edge_count"), F.coalesce(F.sum(F.when(F.col("directed"), 1).otherwise(2)), F.lit(0)).alias("total_degree"))
    average = F.when(F.col("node_count") > 0, F.try_divide(F.col("total_degree").cast("double"), F.col("node_count").cast("double"))).otherwise(0.0)
    pairs = F.col("node_count").cast("double") * (F.col("node_count") - 1).cast("double")
    density = F.when(F.col("node_count") > 1, F.try_divide(F.col("edge_count").cast("double"), pairs)).otherwise(0.0)
    # two frames of one row each
    return n.join(F.broadcast(e)).select("node_count", "edge_count", "total_degree", average.alias("average_in_degree"), average.alias("average_out_degree"), density.alias("density"))


def statistics(nodes: DataFrame, edges: DataFrame) -> dict:
    """All measures of a graph: counts, histograms, degrees, density, orphans, components, cycles."""
    row = degree_stats(nodes, edges).first().asDict()
    row["node_type_counts"] = {r.type: r.n for r in type_histogram(nodes).collect()}
    row["edge_type_counts"] = {r.relationship_type: r.n for r in edge_histogram(edges).collect()}
    row["orphan_count"] = orphans(nodes, edges).count()
    row["connected_component_count"] = components(nodes, edges).select("component").distinct().count()
    row["cycle_count"] = cycles(nodes, edges).count()
    return row


# ---- validation -----------------------------------------------------------------------------------------------------


def _diagnostic(df: DataFrame, level: str, code: str, message: Column, ref: Column) -> DataFrame:
    return df.select(F.lit(level).alias("level"), F.lit(code).alias("code"), message.alias("message"), ref.alias("source_ref"))


def broken_references(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """An error per edge and end that is no node."""
    out = None
    for side in ("source", "target"):
        lost = edges.join(nodes.select(F.col("id").alias(f"{side}_id")), f"{side}_id", "left_anti")
        d = _diagnostic(lost, "error", "broken_reference", F.concat(F.lit(f"edge {side} does not exist: "), f"{side}_id"), F.col("id"))
        out = d if out is None else out.unionByName(d)
    return out


def duplicate_edges(edges: DataFrame) -> DataFrame:
    """(source_id, target_id, relationship_type, n, edge_ids) of edges that repeat; undirected ones are equal either way around."""
    a = F.when(F.col("directed"), F.col("source_id")).otherwise(F.least("source_id", "target_id"))
    b = F.when(F.col("directed"), F.col("target_id")).otherwise(F.greatest("source_id", "target_id"))
    keyed = edges.select(a.alias("source_id"), b.alias("target_id"), "relationship_type", "id")
    key = ["source_id", "target_id", "relationship_type"]
    repeated = keyed.withColumn("n", F.count("*").over(Window.partitionBy(*key))).filter("n > 1")  # lists are made of these only, in the same partitions
    return repeated.groupBy(*key, "n").agg(F.array_sort(F.collect_list("id")).alias("edge_ids"))


def relationship_typing(nodes: DataFrame, edges: DataFrame, relationship_types: DataFrame) -> DataFrame:
    """Errors of edges whose type is unknown, or whose ends have types that it does not allow; synthetic edges are checked like all others."""
    types = dimension(relationship_types.select(F.col("id").alias("relationship_type"), "allowed_from_types", "allowed_to_types", F.lit(True).alias("known")))
    df = edges.join(types, "relationship_type", "left")
    unknown = _diagnostic(df.filter("known IS NULL"), "error", "invalid_relationship_type", F.concat(F.lit("unknown relationship type: "), "relationship_type"), F.col("id"))
    limited = df.filter("size(allowed_from_types) > 0 OR size(allowed_to_types) > 0")
    kinds = nodes.select(F.col("id").alias("node"), F.col("type").alias("node_type"))
    out = unknown
    for side, allowed, code in (("source_id", "allowed_from_types", "invalid_relationship_source"), ("target_id", "allowed_to_types", "invalid_relationship_target")):
        wrong = limited.filter(F.size(allowed) > 0).join(kinds, F.col(side) == F.col("node")).filter(~F.array_contains(F.col(allowed), F.col("node_type")))
        out = out.unionByName(_diagnostic(wrong, "error", code, F.concat("relationship_type", F.lit(" does not allow "), "node_type"), F.col("id")))
    return out


def validate(nodes: DataFrame, edges: DataFrame, relationship_types: DataFrame) -> DataFrame:
    """Diagnostics of a graph: broken references, one cycle per strong component, duplicate edges, orphans, relationship typing."""
    cyclic = _diagnostic(cycles(nodes, edges), "error", "cycle", F.concat(F.lit("cycle of "), F.col("members").cast("string"), F.lit(" nodes")), F.col("scc"))
    twice = _diagnostic(duplicate_edges(edges), "warning", "duplicate_edge", F.concat_ws(" ", F.lit("duplicate edges:"), F.array_join("edge_ids", ", ")), F.col("source_id"))
    lonely = _diagnostic(orphans(nodes, edges), "warning", "orphan_node", F.lit("node has no edges"), F.col("id"))
    return broken_references(nodes, edges).unionByName(cyclic).unionByName(twice).unionByName(lonely).unionByName(relationship_typing(nodes, edges, relationship_types))


# ---- text forms -----------------------------------------------------------------------------------------------------


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, line): 0 for the opening, 1 for nodes, 2 for edges, 3 for the closing line of a DOT file."""
    spark = nodes.sparkSession
    label = dot_label(F.coalesce(F.when(F.col("title") != "", F.col("title")), F.when(F.col("type") != "", F.col("type")), F.col("id")))
    n = nodes.select(F.lit(1).alias("part"), F.concat(F.lit("  "), dot_quote(F.col("id")), F.lit(' [label="'), label, F.lit('"];')).alias("line"))
    e = edges.select(F.lit(2).alias("part"), F.concat(F.lit("  "), dot_quote(F.col("source_id")), F.lit(" -> "), dot_quote(F.col("target_id")), F.lit(' [label="'), dot_label(F.col("relationship_type")), F.lit('"];')).alias("line"))
    ends = spark.createDataFrame([(0, "digraph G {"), (3, "}")], "part int, line string")
    return ends.unionByName(n).unionByName(e)


def cypher_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, line): 1 for nodes, 2 for edges of a Cypher script."""
    n = nodes.select(F.lit(1).alias("part"), F.concat(F.lit("MERGE (n:Node {id: "), cypher_string(F.col("id")), F.lit("}) SET n.type = "), cypher_string(F.col("type")), F.lit(", n.title = "), cypher_string(F.col("title")), F.lit(";")).alias("line"))
    match = F.concat(F.lit("MATCH (a {id: "), cypher_string(F.col("source_id")), F.lit("}), (b {id: "), cypher_string(F.col("target_id")), F.lit("}) MERGE (a)-[:"), "relationship_type", F.lit("]->(b);"))
    return n.unionByName(edges.select(F.lit(2).alias("part"), match.alias("line")))


def jsonl_lines(nodes: DataFrame, edges: DataFrame, metadata: dict | None = None) -> DataFrame:
    """(part, line): records of kind metadata, node and edge."""
    spark = nodes.sparkSession
    record = lambda part, kind, df: df.select(F.lit(part).alias("part"), F.to_json(F.struct(F.lit(kind).alias("kind"), F.struct(*df.columns).alias("data"))).alias("line"))
    out = record(1, "node", nodes).unionByName(record(2, "edge", edges))
    if metadata:
        head = spark.createDataFrame([tuple(map(str, metadata.values()))], ", ".join(f"`{k}` string" for k in metadata))
        out = record(0, "metadata", head).unionByName(out)
    return out
