"""Random graphs and snapshots against plain Python."""

import collections

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.operators import discovery, graph
from lodestone.operators.components import connected_components
from lodestone.operators.keyed import attach, dimension

FEW = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
NAMES = [f"n{i}" for i in range(9)]
EDGES = st.lists(st.tuples(st.sampled_from(NAMES), st.sampled_from(NAMES), st.booleans()), max_size=18)


def frames(spark, edges):
    nodes = spark.createDataFrame([(n, "t") for n in NAMES], "id string, type string")
    rows = [(f"e{i}", "r", s, t, d, i) for i, (s, t, d) in enumerate(edges)]
    return nodes, spark.createDataFrame(rows, "id string, relationship_type string, source_id string, target_id string, directed boolean, seq bigint")


def moves(edges, direction):
    """Steps in the order in which a queue takes them: outgoing ones first, then incoming, by seq; undirected ones both ways."""
    out, into = collections.defaultdict(list), collections.defaultdict(list)
    for i, (s, t, d) in enumerate(edges):
        out[s].append((0, i, t))
        into[t].append((1, i, s))
        if not d:
            out[t].append((0, i, s))
            into[s].append((1, i, t))
    pick = {"outgoing": (out,), "incoming": (into,), "both": (out, into)}[direction]
    return {n: sorted({x for m in pick for x in m[n]}) for n in NAMES}


@FEW
@given(EDGES, st.sampled_from(["outgoing", "incoming", "both"]), st.sampled_from([None, 1, 2]))
def test_bfs(spark, edges, direction, depth):
    nodes, e = frames(spark, edges)
    order, seen, queue, at = [], {"n0": 0}, ["n0"], moves(edges, direction)
    while queue:
        n = queue.pop(0)
        order.append(n)
        if depth is None or seen[n] < depth:
            for _, _, t in at[n]:
                if t not in seen:
                    seen[t] = seen[n] + 1
                    queue.append(t)
    got = graph.bfs(nodes, e, "n0", direction, depth).orderBy("visit").collect()
    assert [r.id for r in got] == order and {r.id: r.distance for r in got} == seen


@FEW
@given(EDGES)
def test_dfs(spark, edges):
    nodes, e = frames(spark, edges)
    order, at = [], moves(edges, "outgoing")

    def visit(n):
        if n not in order:
            order.append(n)
            for _, _, t in at[n]:
                visit(t)

    visit("n0")
    assert [r.id for r in graph.dfs(nodes, e, "n0").orderBy("visit").collect()] == order


@FEW
@given(EDGES)
def test_components_and_cycles(spark, edges):
    nodes, e = frames(spark, edges)
    reach = {n: {n} for n in NAMES}
    both = {n: {n} for n in NAMES}
    for _ in NAMES:
        for s, t, d in edges:
            if d:
                for n in NAMES:
                    if s in reach[n]:
                        reach[n].add(t)
            for n in NAMES:
                if s in both[n] or t in both[n]:
                    both[n] |= {s, t}
    assert {r.id: r.component for r in graph.components(nodes, e).collect()} == {n: min(both[n]) for n in NAMES}
    scc = {n: max(m for m in NAMES if m in reach[n] and n in reach[m]) for n in NAMES}
    for most in (200_000, 0):
        assert {r.id: r.scc for r in graph.strong_components(nodes, e, driver_edges=most).collect()} == scc
    loops = {s for s, t, d in edges if d and s == t}
    sizes = collections.Counter(scc.values())
    assert graph.cycles(nodes, e).count() == sum(n > 1 for n in sizes.values()) + sum(sizes[scc[n]] == 1 for n in loops)


def test_long_chain_and_star(spark):
    chain = spark.range(200).selectExpr("id AS src", "id + 1 AS dst")
    assert {r.component for r in connected_components(chain).collect()} == {0}
    star = spark.range(1, 3000).selectExpr("cast(0 AS bigint) AS src", "id AS dst").union(spark.range(5000, 5001).selectExpr("id AS src", "id AS dst"))
    got = connected_components(star)
    assert got.count() == 3001 and got.filter("component = 0").count() == 3000
    assert connected_components(star.limit(0)).count() == 0
    assert connected_components(spark.createDataFrame([(None, 1), (2, None)], "src int, dst int")).count() == 0


@FEW
@given(st.dictionaries(st.sampled_from("abcdef"), st.sampled_from(["x", "y", None])), st.dictionaries(st.sampled_from("cdefgh"), st.sampled_from(["x", "y", None])))
def test_snapshot_diff(spark, old, new):
    shape = lambda d: spark.createDataFrame([(p, h, 7, i) for i, (p, h) in enumerate(d.items())], "relative_path string, hash string, size bigint, scan_seq bigint")
    want, pool = {}, collections.defaultdict(list)
    for p, h in old.items():
        if p not in new:
            pool[h].append(p)
    for p, h in new.items():
        if p in old:
            want[p] = ("unchanged" if old[p] == h else "modified", None)
        elif pool[h]:
            want[p] = ("renamed", pool[h].pop(0))
        else:
            want[p] = ("new", None)
    want |= {p: ("deleted", None) for ps in pool.values() for p in ps}
    got = discovery.snapshot_diff(shape(old), shape(new)).collect()
    assert {r.relative_path: (r.status, r.previous_path) for r in got} == want and len(got) == len(want)


def test_attach_with_hot_keys(spark):
    facts = spark.range(20_000).selectExpr("id", "if(id % 3 = 0, 'hot', cast(id % 500 AS string)) AS k")
    table = facts.groupBy("k").count().withColumnRenamed("count", "n").selectExpr("k", "n", "concat('v', k) AS v")
    got = attach(facts, table, "k", "n", 20_000)
    assert got.count() == 20_000 and got.filter("v <> concat('v', k)").count() == 0


def test_globs():
    import fnmatch
    import re

    from lodestone.functions.paths import glob_regex

    names = ["a.py", ".env", "x[1]", "a]b", "abc", "a-b", "^a", "A.PY", "a\nb", "", "a/b", "[", "!x"]
    for pattern in ["*.py", "*", "?", "[a]*", "[!a]*", "x[[]1]", "[", "[]]", "a[]-]b", "a?b", "[^a]*", ".*", "*.tar.gz", "[a-c]bc", "[!x]"]:
        for n in names:
            assert bool(re.match(glob_regex(pattern), n)) == fnmatch.fnmatchcase(n, pattern), (pattern, n)


def test_dimension_is_broadcast_only_below_its_bound(spark):
    facts = spark.range(50).withColumnRenamed("id", "k")
    types = spark.range(20).withColumnRenamed("id", "k")
    for rows, hinted in ((19, False), (20, True)):
        joined = facts.join(dimension(types, rows), "k")
        assert ("broadcast" in joined._jdf.queryExecution().logical().toString().lower()) == hinted
        assert joined.count() == 20


def test_duplicate_edges_lists_only_repeated_ones(spark):
    rows = [("a", "x", "y", "t", True), ("b", "y", "x", "t", True), ("c", "x", "y", "t", True), ("d", "x", "y", "u", False), ("e", "y", "x", "u", False), ("f", "x", "z", None, True), ("g", "x", "z", None, True)]
    edges = spark.createDataFrame(rows, "id string, source_id string, target_id string, relationship_type string, directed boolean")
    got = {tuple(r) for r in graph.duplicate_edges(edges).select("source_id", "target_id", "relationship_type", "n", F.array_join("edge_ids", ",")).collect()}
    assert got == {("x", "y", "t", 2, "a,c"), ("x", "y", "u", 2, "d,e"), ("x", "z", None, 2, "f,g")}


def test_dfs_of_long_two_way_chain(spark):
    """A walk along undirected edges takes few jobs, however long they are; one directed step leads on to a second chain."""
    n = 600
    far = lambda i: f"n{i * 7919 % n:03d}"  # noqa: E731  # ids out of order
    rows = [(f"e{i}", "related_to", far(i), far(i + 1), False, i) for i in range(n - 1) if i != n // 2]
    rows += [("d", "depends_on", far(n // 2), far(n // 2 + 1), True, n), ("x", "depends_on", "before", far(0), True, n + 1)]
    edges = spark.createDataFrame(rows, "id string, relationship_type string, source_id string, target_id string, directed boolean, seq long")
    nodes = spark.createDataFrame([(far(i),) for i in range(n)] + [("before",)], "id string")
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("walk", "walk")
    try:
        got = graph.dfs(nodes, edges, far(0)).orderBy("visit").collect()
        assert len(jobs.getJobIdsForGroup("walk")) < 400
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [(r.id, r.distance) for r in got] == [(far(i), i) for i in range(n)]
    half = {far(i) for i in range(n // 2 + 1)}
    for direction, want in (("outgoing", {far(i) for i in range(n)}), ("incoming", half | {"before"}), ("both", {far(i) for i in range(n)} | {"before"})):
        found, count = graph.closure(nodes, edges, far(0), direction)
        assert {r.id for r in found.collect()} == want and count == len(want)
    assert graph.closure(nodes, edges, "none")[1] == 0 and graph.closure(nodes, edges, far(0), edge_types=["depends_on"])[1] == 1
