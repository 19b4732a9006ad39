"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import cut


def _signature(pairs: DataFrame) -> tuple:
    row = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges``, taken as undirected; component is the smallest node reachable.

    Edges with a null endpoint are left out; self-loops keep their node. Nodes may be of any type that can be
    ordered. Each round is two aggregations with map-side combining and two joins whose skewed partitions
    adaptive execution splits; it ends in a checkpoint. The number of rounds grows with the logarithm of the
    longest path. An empty input gives an empty result.
    """
    ends = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    ends = cut(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    nodes = ends.select(F.col("u").alias("node")).union(ends.select("v")).distinct()
    pairs = ends.filter("u <> v")
    seen = _signature(pairs)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("k")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        least = small.select(F.col("u").alias("k"), "m")
        moved = large.join(least, F.col("u") == F.col("k")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = cut(moved.union(small.select("u", F.col("m").alias("v"))).distinct())
        now = _signature(pairs)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(pairs.select(F.col("u").alias("node"), F.col("v").alias("least")), "node", "left").select("node", F.coalesce("least", "node").alias("component"))
