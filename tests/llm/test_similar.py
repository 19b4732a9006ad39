"""The near-dedup stage against brute-force Jaccard similarity."""

import collections
import random
import re

import pytest

pytest.importorskip("lodestone.llm")
from cases import awkward, documents, empty  # noqa: E402

from lodestone.llm import simhash  # noqa: E402


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or frozenset([tuple(w)] if w else [])


def brute_kept(docs, least=0.8):
    """Least doc_id of each component of pairs of at least ``least``; every pair is compared."""
    sets = collections.defaultdict(set)
    for i, text in docs:
        sets[shingles(text)].add(i)
    points = list(sets)
    parent = list(range(len(points)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(points):
        for j in range(i):
            both = len(a & points[j])
            if both and 10 * both >= round(10 * least) * (len(a) + len(points[j]) - both):
                parent[find(i)] = find(j)
    groups = collections.defaultdict(set)
    for i, a in enumerate(points):
        groups[find(i)] |= sets[a]
    return sorted({min(g) for g in groups.values()})


def edited(spark):
    """Families of texts with words replaced at random, so that similarities lie all around 0.8, and a common passage."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5000)}"
    common = [word() for _ in range(30)]
    rows = []
    for family in range(30):
        base = [word() for _ in range(rng.choice([12, 60, 150]))] + common
        for copy in range(8):
            rows.append((len(rows), " ".join(word() if copy and rng.random() < 0.004 * copy else w for w in base)))
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def long_edited(spark):
    """Families of long texts, copies up to a third longer, so that sizes and lengths of parities differ within a family."""
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(20_000)}"
    rows = []
    for size in (250, 1000, 1020, 4000):
        base = [word() for _ in range(size)]
        for copy in range(8):
            rows.append((len(rows), " ".join(base + [word() for _ in range(size * copy // 24)])))
    return spark.createDataFrame(rows, "doc_id bigint, text string")


@pytest.mark.parametrize("make", [edited, long_edited, awkward, documents, empty])
def test_stage_leaves_one_of_each_group(spark, make):
    docs = make(spark).filter("doc_id IS NOT NULL")
    left = simhash.keep(spark, docs, "")
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == brute_kept([(r.doc_id, r.text) for r in docs.collect()])


def test_fingerprints_name_pairs(spark, monkeypatch):
    """The trees connect all pairs within the radii, by such pairs only; and they link near copies where the exact filter that follows finds nothing."""
    from pyspark.sql import functions as F

    from lodestone.llm import similar
    from lodestone.session import cut

    docs = documents(spark).unionByName(edited(spark).withColumn("doc_id", F.col("doc_id") + 10**9), allowMissingColumns=True)
    rows = similar.sketches(docs, similar.shingle_counts(docs))
    points = cut(rows.filter("size > 0").select("fp", "size", "bits", "more").distinct())
    at = {r.fp: r for r in points.collect()}
    near = {(a, b) for a in at for b in at if a < b and (d := bin((at[a].bits ^ at[b].bits) % 2**64).count("1")) <= simhash.NEAR and d + bin((at[a].more ^ at[b].more) % 2**64).count("1") <= simhash.NEAR_BOTH and min(at[a].size, at[b].size) >= 0.8 * max(at[a].size, at[b].size) - 1e-9}
    got = {(r.a, r.b) for r in simhash.candidates(points).collect()}
    parts = lambda pairs: similar.connected_components(spark.createDataFrame(sorted(pairs), "a bigint, b bigint"), "a", "b").collect()
    assert near and got <= near and {tuple(r) for r in parts(got)} == {tuple(r) for r in parts(near)}
    shared = similar.shared_shingles
    monkeypatch.setattr(similar, "shared_shingles", lambda rows: shared(rows).limit(0))
    left, true = simhash.keep(spark, docs, "").count(), len(brute_kept([(r.doc_id, r.text) for r in docs.collect()]))
    distinct = len({shingles(r.text) for r in docs.collect()})
    assert true <= left < (true + distinct) / 2
