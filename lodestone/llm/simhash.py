"""SimHash near-dedup: fingerprints of word shingles, joined within a Hamming radius by vantage-point trees."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import similar
from lodestone.llm.words import bounded, slices, table, text_or_empty
from lodestone.operators.components import connected_components
from lodestone.operators.keyed import attach
from lodestone.session import cut, ship

SEED, RADIUS = 42, 3
#: Fingerprints from which the upper tree is built; all of them are joined.
SAMPLE = 8192
#: Fingerprints whose home is one shard, about.
SHARD = 8192
#: The upper tree has at most 2 ** MAX_DEPTH leaves, so that what is broadcast is below 1 MB.
MAX_DEPTH = 16
#: Home points of a leaf of the trees within shards, and pairs that are held before they are merged into classes.
LEAF, HELD = 128, 2_000_000
#: The pipeline's stage: bits of the first 64 in which near copies may differ, and of all 128. See the README for what they reach.
NEAR, NEAR_BOTH = 14, 28
#: At this radius nearly every point visits every shard of its band, so the stage's upper tree has 2 ** NEAR_DEPTH leaves at any size:
#: the copies of a point stay as many, about 1.5 times the leaves.
NEAR_DEPTH = 3


# ---- fingerprints ---------------------------------------------------------------------------------------------------


def fingerprint(text: str, words: int = 3) -> int:
    """Bit i is set if it is set in over half of the XXH64 hashes of all shingles, repeats included.

    A-Z are lower-cased. A text of fewer words is one shingle; one without words has the fingerprint 0.
    """
    from xxhash import xxh64_intdigest

    w = text.encode("utf-8").lower().split()  # bytes: only ASCII letters and white space are touched
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    return similar.majority(np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n))


def fingerprints(docs: DataFrame, words: int = 3, text: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint's 64 bits as a signed integer. A null text counts as empty."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(t, words) for t in batch.column("__text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    slim = docs.select("doc_id", text_or_empty(text).alias("__text"))
    return slim.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp bigint")


# ---- vantage-point trees --------------------------------------------------------------------------------------------


def distances(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage).astype(np.int16)


def split_at(points: np.ndarray, tries: int = 4) -> tuple[np.uint64, int] | None:
    """A vantage point among ``points`` and the distance that divides them most evenly; None if none of a few divides them."""
    best = None
    for i in range(tries):
        vantage = points[(i * len(points)) // tries]
        d = distances(points, vantage)
        for mu in {int(np.median(d)), int(np.median(d)) - 1}:
            inside = int((d <= mu).sum())
            if 0 < inside < len(points) and (best is None or min(inside, len(points) - inside) > best[0]):
                best = (min(inside, len(points) - inside), vantage, mu)
    return best and best[1:]


def upper_tree(sample: np.ndarray, depth: int):
    """(vantage, mu, inner, outer), or the number of a leaf; leaves count from 0 in order."""
    leaves = iter(range(1 << MAX_DEPTH + 1))

    def grow(points: np.ndarray, depth: int):
        found = split_at(points) if depth and len(points) > 1 else None
        if found is None:
            return next(leaves)
        vantage, mu = found
        near = distances(points, vantage) <= mu
        return (vantage, mu, grow(points[near], depth - 1), grow(points[~near], depth - 1))

    return grow(sample, depth)


def place(tree, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(leaf, index of the point, at home) for each leaf that a point's ball of ``radius`` can reach.

    Visits go only to leaves after the point's home: of two linked points in different leaves, the earlier one visits.
    """
    leaf, at, own, home = reached(tree, points, radius)
    use = own | (leaf > home)
    return leaf[use], at[use], own[use]


def reached(tree, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(leaf, index of the point, at home, the point's home) for all leaves that balls of ``radius`` can reach.

    By the triangle inequality the ball misses the inner side if d - radius > mu, and the outer one if d + radius <= mu.
    """
    home = np.zeros(len(points), np.int64)
    found: list[tuple[int, np.ndarray, np.ndarray]] = []

    def walk(node, at: np.ndarray, own: np.ndarray) -> None:
        if not len(at):
            return
        if not isinstance(node, tuple):
            home[at[own]] = node
            found.append((node, at, own))
            return
        vantage, mu, inner, outer = node
        d = distances(points[at], vantage)
        near, far = d - radius <= mu, d + radius > mu
        walk(inner, at[near], own[near] & (d[near] <= mu))
        walk(outer, at[far], own[far] & (d[far] > mu))

    walk(tree, np.arange(len(points)), np.ones(len(points), bool))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
    leaf = np.concatenate([np.full(len(a), n, np.int64) for n, a, _ in found])
    at, own = np.concatenate([a for _, a, _ in found]), np.concatenate([o for _, _, o in found])
    return leaf, at, own, home[at]


class Classes:
    """Merges pairs of indices into classes, a block of pairs at a time."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.left: list[np.ndarray] = []
        self.right: list[np.ndarray] = []
        self.held = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.left.append(a)
        self.right.append(b)
        self.held += len(a)
        if self.held > HELD:
            self.merge()

    def merge(self) -> np.ndarray:
        if self.held:
            a, b, lab = np.concatenate(self.left), np.concatenate(self.right), self.label
            while True:
                la, lb = lab[a], lab[b]
                differ = la != lb
                if not differ.any():
                    break
                a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
                np.minimum.at(lab, np.maximum(la, lb), np.minimum(la, lb))
                while (nxt := lab[lab]).tobytes() != lab.tobytes():
                    lab = nxt
            self.label, self.left, self.right, self.held = lab, [], [], 0
        return self.label


def link(points: np.ndarray, homes: int, radius: int) -> np.ndarray:
    """A class for each of ``points``, of which the first ``homes`` are compared with all; pairs within ``radius`` share theirs."""
    classes = Classes(len(points))
    for a, b in close_pairs(points, homes, radius):
        classes.add(a, b)
    return classes.merge()


def close_pairs(points: np.ndarray, homes: int, radius: int, cells: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of all pairs (a, b) of indices within ``radius``, a among the first ``homes``; a pair of these comes both ways, each with itself.

    A vantage-point tree over the home points is walked with all points at once; the triangle inequality keeps points
    off the branches that their balls miss. Only leaves compare pairs, in blocks of at most ``cells``.
    """

    def compare(h: np.ndarray, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i in range(0, len(h), 1024):
            mine = h[i : i + 1024]
            step = max(1, cells // len(mine))
            for j in range(0, len(q), step):
                other = q[j : j + step]
                x, y = np.nonzero(np.bitwise_count(points[mine][:, None] ^ points[other][None, :]) <= radius)
                if len(x):
                    yield mine[x], other[y]

    def walk(h: np.ndarray, q: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        found = split_at(points[h]) if len(h) > LEAF and len(q) and depth < 64 else None
        if found is None:
            if len(h) and len(q):
                yield from compare(h, q)
            return
        vantage, mu = found
        dh, dq = distances(points[h], vantage), distances(points[q], vantage)
        yield from walk(h[dh <= mu], q[dq - radius <= mu], depth + 1)
        yield from walk(h[dh > mu], q[dq + radius > mu], depth + 1)

    return walk(np.arange(homes), np.arange(len(points)), 0)


def links(points: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between the ``rep`` of distinct fingerprints (fp, rep), so that those within ``radius`` are connected.

    A bounded sample of the fingerprints makes the upper tree, whose leaves are shards. Every fingerprint goes to its
    home shard and to those that its ball overlaps; each shard finds its exact pairs and returns a spanning forest of
    them instead of all. Fingerprints are distinct, so a dense spot stays small: a ball of radius 3 has 43,745 at most.
    """
    spark = points.sparkSession
    depth = min(MAX_DEPTH, max(4, int(np.ceil(np.log2(max(1, n) / SHARD)))))
    drawn = points.select("fp").orderBy(F.xxhash64(F.lit(SEED), "fp")).limit(SAMPLE).collect()
    shared = spark.sparkContext.broadcast(upper_tree(np.array([r.fp for r in drawn], np.int64).view(np.uint64), depth))

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, reps = batch.column("fp").to_numpy(zero_copy_only=False), batch.column("rep").to_numpy(zero_copy_only=False)
            for k in range(0, len(fps), 4096):
                leaf, at, own = place(shared.value, fps[k : k + 4096].view(np.uint64), radius)
                yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), pa.array(fps[k : k + 4096][at]), pa.array(reps[k : k + 4096][at]), pa.array(own)], ["leaf", "fp", "rep", "own"])

    def gather(group: pa.Table) -> pa.Table:
        own = group.column("own").to_numpy()
        order = np.argsort(~own, kind="stable")
        fps, reps = group.column("fp").to_numpy()[order].view(np.uint64), group.column("rep").to_numpy()[order]
        label = link(fps, int(own.sum()), radius)
        tied = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": pa.array(reps[tied]), "b": pa.array(reps[label[tied]])})

    scattered = points.select("fp", "rep").mapInArrow(scatter, "leaf int, fp bigint, rep bigint, own boolean")
    return scattered.groupBy("leaf").applyInArrow(gather, "a bigint, b bigint")


def forest(points: np.ndarray, more: np.ndarray, sizes: np.ndarray, homes: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of indices that connect all pairs which close_pairs(), NEAR_BOTH and the sizes leave; each is such a pair itself.

    Of a block the closest pairs come first. Pairs that are connected already are skipped, so that a large group of copies gives few.
    """
    label = np.arange(len(points))
    left: list[int] = []
    right: list[int] = []
    for a, b in close_pairs(points, homes, NEAR, cells=1 << 17):  # in a group of copies all pairs of a block are close, about 100 bytes each
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
        apart = np.bitwise_count(points[a] ^ points[b]).astype(np.int16) + np.bitwise_count(more[a] ^ more[b])
        fits = (apart <= NEAR_BOTH) & (np.minimum(sizes[a], sizes[b]) >= similarity * np.maximum(sizes[a], sizes[b]) - 1e-9)
        order = np.argsort(apart[fits], kind="stable")
        a, b = a[fits][order], b[fits][order]
        while len(a):
            # the first pair of every class that is not yet connected joins it to another one
            la, lb = label[a], label[b]
            _, k = np.unique(np.maximum(la, lb), return_index=True)
            left += a[k].tolist()
            right += b[k].tolist()
            np.minimum.at(label, np.maximum(la, lb)[k], np.minimum(la, lb)[k])
            while (nxt := label[label]).tobytes() != label.tobytes():
                label = nxt
            open_ = label[a] != label[b]
            a, b = a[open_], b[open_]
    return np.array(left, np.int64), np.array(right, np.int64)


def candidates(points: DataFrame, similarity: float = similar.SIMILARITY) -> DataFrame:
    """(a, b), a < b: pairs of sets (fp, size, bits, more: materialised) whose fingerprints connect them, for a check by their similarity.

    Vantage-point trees as in links(), at radius NEAR over ``bits``. Sets of this similarity differ in size by a bounded factor, so points
    fall into bands of sizes, and each meets those of its own band and of the next one only. Of each shard's pairs a spanning forest is returned.
    """
    spark = points.sparkSession
    ship(spark)
    banded = points.withColumn("band", F.floor(F.log("size") / -float(np.log(similarity))).cast("int"))
    drawn = points.select("bits").orderBy(F.xxhash64(F.lit(SEED), "bits")).limit(SAMPLE).collect()
    shared = spark.sparkContext.broadcast(upper_tree(np.array([r.bits for r in drawn], np.int64).view(np.uint64), NEAR_DEPTH))
    schema = pa.schema([("band", pa.int32()), ("leaf", pa.int32()), ("own", pa.bool_()), ("fp", pa.int64()), ("size", pa.int32()), ("bits", pa.int64()), ("more", pa.int64())])

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            of = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "size", "bits", "more", "band")}
            leaf, at, own, home = reached(shared.value, of["bits"].view(np.uint64), NEAR)
            here = own | (leaf > home)
            for use, mine, up in ((here, own[here], 0), (np.ones(len(leaf), bool), np.zeros(len(leaf), bool), 1)):
                k = at[use]
                columns = [of["band"][k] + np.int32(up), leaf[use].astype(np.int32), mine, of["fp"][k], of["size"][k], of["bits"][k], of["more"][k]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def gather(group: pa.Table) -> pa.Table:
        own = group.column("own").to_numpy()
        order = np.argsort(~own, kind="stable")
        fp, size, bits, more = (group.column(c).to_numpy()[order] for c in ("fp", "size", "bits", "more"))
        a, b = forest(bits.view(np.uint64), more.view(np.uint64), size, int(own.sum()), similarity)
        return pa.table({"a": pa.array(np.minimum(fp[a], fp[b])), "b": pa.array(np.maximum(fp[a], fp[b]))})

    scattered = banded.select("fp", "size", "bits", "more", "band").mapInArrow(scatter, "band int, leaf int, own boolean, fp bigint, size int, bits bigint, more bigint")
    return scattered.groupBy("band", "leaf").applyInArrow(gather, "a bigint, b bigint")


def near_groups(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``rows`` (doc_id, fp: materialised) with ``component_id``, the least doc_id that links of at most ``radius`` bits reach.

    Copies are one fingerprint from the start. Rows without doc_id get the component of their fingerprint; where all
    rows of a fingerprint lack it, it takes no part in links and its component is null.
    """
    points = cut(rows.groupBy("fp").agg(F.min("doc_id").cast("long").alias("rep"), F.count("*").alias("__n")))
    pairs = links(points.filter("rep IS NOT NULL"), points.count(), radius)
    components = connected_components(cut(pairs.distinct()), "a", "b")
    known = cut(points.join(components, F.col("rep") == F.col("node"), "left").select("fp", "__n", F.coalesce("component", "rep").alias("component_id")))
    return attach(rows, known, "fp", "__n", rows.count()).drop("__n")


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    rows = cut(fingerprints(table(spark, folder, "documents")))
    return near_groups(rows).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep(spark: SparkSession, docs: DataFrame, folder: str, words: int = similar.WORDS, similarity: float = similar.SIMILARITY) -> DataFrame:
    """Pipeline stage: of each group of near copies, the row with the least doc_id stays (null ids after all others).

    Near copies have a Jaccard similarity of at least ``similarity`` over shingles of ``words`` words. Fingerprints joined by
    vantage-point trees name the pairs; an exact check follows, which also finds those that fingerprints miss, see similar.py. Null and empty texts are one group. Rows that stay are not moved; an empty table stays empty.
    Where rows that stay share a doc_id, one of each group stays, the smallest by its columns as JSON.
    """
    rows = cut(similar.near_groups(docs, candidates, words, similarity))
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    per_id = rows.groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("n"), F.bool_or(stays).alias("stays"))
    per_id = cut(per_id.filter("n > 1 OR NOT stays"))  # most rows are not among these, and stay where they are
    single = docs.join(bounded(per_id.select("__id")), F.col("doc_id").eqNullSafe(F.col("__id")), "left_anti")
    repeated = per_id.filter("n > 1 AND stays").select("__id")
    if not repeated.count():
        return single
    several = rows.filter(stays).join(bounded(repeated), F.col("doc_id").eqNullSafe(F.col("__id")))
    ids = several.select("__id", "fp", "component_id").distinct()
    again = docs.join(ids.select(F.col("__id").alias("__i")).distinct(), F.col("doc_id").eqNullSafe(F.col("__i")), "left_semi")
    carried = again.withColumn("__row", F.struct(*[F.col(c) for c in docs.columns])).select("__row", F.to_json("__row").alias("__json"))
    marked = _with_key(carried, words).join(ids, F.col("__row.doc_id").eqNullSafe(F.col("__id")) & (F.col("__fp") == F.col("fp")))
    # rows without an id have no component of their own: there each fingerprint is a group
    one = marked.groupBy("__id", F.coalesce("component_id", "fp").alias("__c")).agg(F.min_by("__row", "__json").alias("__row")).select("__row.*")
    return single.unionByName(one)


def _with_key(rows: DataFrame, words: int) -> DataFrame:
    """``rows`` (__row, __json) with ``__fp``, the key of the set of the text's shingles."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("bigint")
    def fp(texts):
        return texts.map(lambda t: similar.set_key(similar.shingle_set(t or "", words)))

    return rows.withColumn("__fp", fp(F.col("__row.text").cast("string")))
