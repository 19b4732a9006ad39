"""Queries over the whole graph against plain Python, with nodes and edges from DuckDB."""

import collections

import oracle

from lodestone.plans import catalogue
from lodestone.plans import tables_graph as T

FOLDER = "/root/testdata/sf0.001"


def run(spark, name):
    return catalogue.QUERIES[name](spark, FOLDER).collect()


def whole():
    db = oracle.duck(FOLDER)
    nodes = [r[0] for r in db.sql(f"WITH {T.NODES_SQL} SELECT id FROM nodes").fetchall()]
    edges = db.sql(f"WITH {T.EDGES_SQL} SELECT source_id, target_id, directed, relationship_type FROM edges").fetchall()
    return nodes, edges


def test_components(spark):
    nodes, edges = whole()
    near = collections.defaultdict(set)
    for s, t, *_ in edges:
        near[s].add(t)
        near[t].add(s)
    want = {}
    for start in sorted(nodes):
        stack = [] if start in want else [start]
        while stack:
            if (n := stack.pop()) not in want:
                want[n] = start
                stack += near[n]
    assert {r.id: r.component for r in run(spark, "connected_components_whole")} == want


def test_strong_components_and_cycles(spark):
    db = oracle.duck(FOLDER)
    nodes = ["supplier:" + str(r[0]) for r in db.sql("SELECT s_suppkey FROM supplier").fetchall()]
    after = collections.defaultdict(set)
    lines = collections.defaultdict(list)
    for o, _, _, s in sorted(db.sql("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem").fetchall()):
        lines[o].append(f"supplier:{s}")
    for walk in lines.values():
        for s, t in zip(walk, walk[1:], strict=False):
            after[s].add(t)

    def reach(start):
        seen, stack = set(), [start]
        while stack:
            if (n := stack.pop()) not in seen:
                seen.add(n)
                stack += after[n]
        return seen

    reached = {n: reach(n) for n in nodes}
    want = {n: max(m for m in reached[n] if n in reached[m]) for n in nodes}
    for name in ("strong_components_whole", "strong_components_distributed_whole"):
        assert {r.id: r.scc for r in run(spark, name)} == want
    sizes = collections.Counter(want.values())
    assert {r.scc: r.members for r in run(spark, "cycle_count_whole")} == {c: n for c, n in sizes.items() if n > 1 or c in after[c]}


def test_walk_reaches_all(spark):
    _, edges = whole()
    after = collections.defaultdict(set)
    for s, t, directed, _ in edges:
        after[s].add(t)
        if not directed:
            after[t].add(s)
    seen, stack = set(), ["customer:1"]
    while stack:
        if (n := stack.pop()) not in seen:
            seen.add(n)
            stack += after[n]
    rows = sorted(run(spark, "dfs_order_whole"), key=lambda r: r.visit)
    assert [r.visit for r in rows] == list(range(len(seen))) and {r.id for r in rows} == seen and len({r.id for r in rows}) == len(rows)


def test_validation(spark):
    nodes, edges = whole()
    got = {r.code: r.n for r in run(spark, "graph_validation_tallies_whole")}
    same = collections.Counter((*((s, t) if d else sorted((s, t))), k) for s, t, d, k in edges)
    ends = {x for s, t, *_ in edges for x in (s, t)}
    assert got.get("duplicate_edge", 0) == sum(n > 1 for n in same.values())
    assert got.get("orphan_node", 0) == len(set(nodes) - ends)
    assert got.get("broken_reference", 0) == sum(x not in set(nodes) for s, t, *_ in edges for x in (s, t))
    assert got.get("cycle", 0) == 0  # regions, nations, parts and customers have no directed way back
