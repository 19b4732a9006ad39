"""The exact check of near copies: Jaccard similarity of word shingles, and a prefix filter that finds pairs which fingerprints miss.

Fingerprints name pairs first, see simhash.py. A radius cannot promise all pairs, as bits of short texts scatter; so what is
still apart after that goes through the filter.

How the filter works: all shingles are put in one order, rare ones first. Two sets of similarity s share a shingle among
the first n - ceil(s * n) + 1 of each, whatever the order is, so no pair is missed. The order decides the cost only: a copy
with more than a fifth of shingles of its own has only those in its prefix and meets nobody, however large its group is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.words import BROADCAST_ROWS, bounded, slices, text_or_empty
from lodestone.operators.components import connected_components
from lodestone.operators.keyed import attach
from lodestone.session import cut, ship

SEED = 42
WORDS, SIMILARITY = 5, 0.8
#: Shingles are counted by the first BITS bits of their hash, over all rows: 4 MB at any size. PIECE of these counts make one row.
BITS, PIECE = 20, 1 << 14
#: Tasks whose counts one task adds up.
FAN_IN = 64
#: A shingle in at most so many rows, or in at most so many times the mean of all counts, is held together by one task; the count's upper bound is known.
FEW, TIMES = 1000, 4
#: The least number of bits that tell most pairs below the similarity apart before their sets are fetched; larger sets have one to two for each shingle.
PARITIES = 64
#: Members of a shingle that all others meet first, before those that are still apart meet each other.
HUBS = 3


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct XXH64 hashes of the shingles. A-Z are lower-cased; a text of fewer words is one shingle, none without words."""
    from xxhash import xxh64_intdigest

    w = text.encode("utf-8").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    return np.unique(np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64))


def set_key(shingles: np.ndarray) -> int:
    """One signed integer of 64 bits for equal sets."""
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(shingles.astype("<u8").tobytes(), SEED)).view(np.int64))


def majority(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the ``hashes``; 0 for none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        block = hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def print_of(shingles: np.ndarray) -> tuple[int, int]:
    """SimHash fingerprint of a set in 128 bits, as two signed integers; the second is made of the hashes mixed once more."""
    mixed = (shingles ^ (shingles >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return tuple(int(np.uint64(majority(h)).view(np.int64)) for h in (shingles, mixed))


def parity(shingles: np.ndarray) -> np.ndarray:
    """Bits, each telling whether an odd number of the shingles falls on it, as signed integers of 64 bits.

    Their number is the next power of two to that of the shingles, so that unrelated sets of any size differ in many. Two
    sets differ in at least as many shingles as their parities differ in bits, the longer one folded to the shorter, see folded().
    """
    bits = max(PARITIES, 1 << max(len(shingles) - 1, 0).bit_length())
    odd = np.bincount((shingles % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - BITS)).astype(np.int64)


def shingle_counts(docs: DataFrame, words: int = WORDS) -> np.ndarray:
    """For each bucket of shingles, in how many rows of ``docs`` one is, over all rows; 2 ** BITS numbers.

    Each task adds up its own rows and returns what is not 0; then FAN_IN tasks at a time are added up.
    """
    ship(docs.sparkSession)
    schema = "piece int, part int, place binary, n binary"

    def encoded(piece: int, part: int, counts: np.ndarray) -> tuple:
        place = np.flatnonzero(counts)
        return piece, part, place.astype("<u2").tobytes(), counts[place].astype("<u8" if counts.max(initial=0) >> 32 else "<u4" if counts.max(initial=0) >> 16 else "<u2").tobytes()

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["piece", "part", "place", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BITS, np.int64)
        for batch in slices(batches):
            found = [shingle_set(t, words) for t in batch.column("__text").to_pylist()]
            counts += np.bincount(bucket(np.concatenate(found)), minlength=1 << BITS) if found else 0
        part = TaskContext.get().partitionId()
        rows = [encoded(k, part, c) for k, c in enumerate(counts.reshape(-1, PIECE)) if c.any()]
        if rows:
            yield batch_of(rows)

    def add(group: pa.Table) -> pa.Table:
        counts = np.zeros(PIECE, np.int64)
        for row in group.to_pylist():
            place = np.frombuffer(row["place"], "<u2")
            counts[place] += np.frombuffer(row["n"], f"<u{len(row['n']) // max(len(place), 1)}").astype(np.int64)
        return pa.Table.from_batches([batch_of([encoded(group.column("piece")[0].as_py(), group.column("part")[0].as_py() // FAN_IN, counts)])])

    slim = docs.select(text_or_empty().alias("__text"))
    rows, parts = slim.mapInArrow(count, schema), slim.rdd.getNumPartitions()
    while True:
        rows = rows.groupBy("piece", F.floor(F.col("part") / FAN_IN)).applyInArrow(add, schema)
        parts = -(-parts // FAN_IN)
        if parts <= 1:
            break
    total = np.zeros((1 << BITS) // PIECE * PIECE, np.int64).reshape(-1, PIECE)
    for row in rows.collect():  # at most 2 ** BITS numbers
        place = np.frombuffer(row.place, "<u2")
        total[row.piece][place] += np.frombuffer(row.n, f"<u{len(row.n) // max(len(place), 1)}").astype(np.int64)
    return total.reshape(-1)


def prefix(shingles: np.ndarray, counts: np.ndarray, similarity: float, few: float) -> tuple[np.ndarray, int]:
    """The first shingles in the common order, of which sets of this similarity share at least one, and how many of them are in at most ``few`` rows."""
    n = len(shingles)
    found = counts[bucket(shingles)]
    order = np.argsort(found, kind="stable")[: n - int(np.ceil(similarity * n - 1e-9)) + 1]  # equal counts: by hash
    return shingles[order], int((found[order] <= few).sum())


def sketches(docs: DataFrame, counts: np.ndarray, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, fp, size, prefix, few, parity, bits, more) of every row; fp is the key of its set, bits and more are its fingerprint. A null text counts as empty, its prefix is empty too."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(counts.astype(np.uint32 if counts.max(initial=0) < 1 << 32 else np.int64))

    few = max(FEW, TIMES * float(counts.mean()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(t, words) for t in batch.column("__text").to_pylist()]
            first = [prefix(s, shared.value, similarity, few) for s in sets]
            prints = [print_of(s) for s in sets]
            columns = [batch.column("doc_id"), pa.array([set_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([f.view(np.int64) for f, _ in first], pa.list_(pa.int64())), pa.array([n for _, n in first], pa.int32()), pa.array([parity(s) for s in sets], pa.list_(pa.int64())), pa.array([b for b, _ in prints], pa.int64()), pa.array([m for _, m in prints], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "size", "prefix", "few", "parity", "bits", "more"])

    slim = docs.select("doc_id", text_or_empty().alias("__text"))
    return slim.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp bigint, size int, prefix array<bigint>, few int, parity array<bigint>, bits bigint, more bigint")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(fp, shingles) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(t, words) for t in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["fp", "shingles"])

    return docs.select(text_or_empty().alias("__text")).mapInArrow(run, "fp bigint, shingles binary")


def may_link(similarity: float) -> Column:
    """Whether a row (fp, size, pos) and ``other`` can reach the similarity, if the shingle that they share is their first common one.

    By their sizes, and by how many shingles are behind that one in either. A pair that can is found at its first common shingle.
    """
    size, other = F.col("size"), F.col("other.size")
    overlap = F.least(size - F.col("pos"), other - F.col("other.pos"))
    fits = F.least(size, other) >= similarity * F.greatest(size, other) - 1e-9
    return fits & (overlap >= similarity / (1 + similarity) * (size + other) - 1e-9) & (F.col("fp") != F.col("other.fp"))


def folded(bits: str, words: Column) -> Column:
    """The parity in column ``bits`` as it is with that many integers, a smaller power of two: bit i is the parity of bits i, i + 64 * words, ..."""
    xor = lambda first: F.aggregate(F.sequence(first, F.size(bits) - 1, words), F.lit(0).cast("long"), lambda x, k: x.bitwiseXOR(F.get(bits, k)))
    return F.when(F.size(bits) == words, F.col(bits)).otherwise(F.transform(F.sequence(F.lit(0), words - 1), xor))


def not_apart(pairs: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b: materialised) but those whose parities differ in more bits than sets of this similarity may differ in shingles."""
    total = pairs.count()
    for key in ("a", "b"):
        weights = cut(pairs.groupBy(F.col(key).alias("fp")).agg(F.count("*").alias("__n")))
        known = rows.select("fp", "size", "parity").join(bounded(weights), "fp").dropDuplicates(["fp"])
        pairs = cut(attach(pairs, cut(known.withColumnsRenamed({"size": f"size_{key}", "parity": f"parity_{key}"})), key, "__n", total, "fp").drop("__n"))
    words = F.least(F.size("parity_a"), F.size("parity_b"))
    apart = F.aggregate(F.zip_with(folded("parity_a", words), folded("parity_b", words), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return pairs.filter(apart <= (1 - similarity) / (1 + similarity) * (F.col("size_a") + F.col("size_b")) + 1e-9).select("a", "b")


def verified(pairs: DataFrame, docs: DataFrame, points: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b: materialised) of sets that have at least this Jaccard similarity; the sets are made anew from one text each.

    Sets are dealt to their pairs once: where pairs are few they are broadcast to the texts, beyond that attach() joins them.
    """
    total = 2 * pairs.count()
    ends = pairs.select(F.col("a").alias("fp"), "a", "b").union(pairs.select("b", "a", "b"))
    weights = cut(ends.groupBy("fp").agg(F.count("*").alias("__n")))
    ids = cut(points.join(bounded(weights), "fp", "left_semi").select(F.col("rep").alias("__rep")))
    sets = shingle_sets(docs.join(bounded(ids), F.col("doc_id") == F.col("__rep"), "left_semi"), words)
    if total <= BROADCAST_ROWS:
        dealt = sets.join(F.broadcast(ends), "fp")
    else:
        dealt = attach(ends, cut(sets.join(weights, "fp").dropDuplicates(["fp"])), "fp", "__n", total)
    side = lambda k: F.first(F.when(F.col("fp") == F.col(k), F.col("shingles")), ignorenulls=True).alias(f"s{k}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kept = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return dealt.groupBy("a", "b").agg(side("a"), side("b")).mapInArrow(run, "a bigint, b bigint")


def shared_shingles(rows: DataFrame) -> DataFrame:
    """(shingle, fp, size, pos) of the shingles in the prefixes of ``rows`` that different sets share.

    A shingle in few rows is looked at by the task that holds it; one that may be in many rows is counted first and joined by attach().
    """
    held = rows.filter("doc_id IS NOT NULL").select("fp", "size", "few", F.posexplode("prefix").alias("pos", "shingle"))
    within = Window.partitionBy("shingle")
    few = held.filter("pos < few").select("shingle", "fp", "size", "pos").withColumns({"x": F.min("fp").over(within), "y": F.max("fp").over(within)}).filter("x <> y").drop("x", "y")
    many = held.filter("pos >= few").select("shingle", "fp", "size", "pos")
    common = cut(many.groupBy("shingle").agg(F.count("*").alias("__m"), F.min("fp").alias("x"), F.max("fp").alias("y")).filter("x <> y").drop("x", "y"))
    total = common.agg(F.sum("__m")).first()[0] or 0
    return few.unionByName(attach(many, common, "shingle", "__m", total).drop("__m")).distinct()


def _classes(members: DataFrame, component: DataFrame) -> DataFrame:
    """``members`` (fp, ...) with ``class``, the least fp that links reach."""
    return members.join(component, F.col("fp") == F.col("node"), "left").select(*members.columns, F.coalesce("component", "fp").alias("class"))


def near_groups(docs: DataFrame, candidates: Callable[[DataFrame, float], DataFrame], words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the least doc_id that pairs of at least ``similarity`` reach.

    Equal sets are one point from the start. ``candidates`` names pairs (a, b) of points (fp, size, bits, more) by their fingerprints.
    The exact filter adds those that it misses: members of a shingle first meet a few of them, those with the least rare
    shingles before it, so that a large group becomes one class by few comparisons; then members that are still in different classes
    meet each other. Every link is verified by exact Jaccard similarity. Rows without doc_id get the component of
    their set; where all rows of a set lack it, it takes no part in links and its component is null. Texts without words are
    one set, which links to no other. An empty table has no rows.
    """
    rows = cut(sketches(docs, shingle_counts(docs, words), words, similarity))
    points = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("__n"), *[F.min(c).alias(c) for c in ("size", "bits", "more")]))
    shared = cut(shared_shingles(rows))
    total = shared.count()
    each = cut(shared.groupBy("fp").agg(F.count("*").alias("__w")))
    named = candidates(points.filter("rep IS NOT NULL AND size > 0").select("fp", "size", "bits", "more"), similarity)
    ordered = lambda df: df.select(F.least("fp", "other.fp").alias("a"), F.greatest("fp", "other.fp").alias("b"))
    check = lambda pairs: cut(verified(cut(not_apart(cut(pairs.distinct()), rows, similarity)), docs, points, words, similarity))
    hub = lambda k: F.min_by(F.struct("fp", "size", "pos"), F.struct("pos", F.xxhash64(F.lit(k), "shingle", "fp")))
    hubs = cut(shared.groupBy("shingle").agg(F.count("*").alias("__m"), F.array_distinct(F.array(*[hub(k) for k in range(HUBS)])).alias("hubs")))
    links = check(named.union(ordered(attach(shared, hubs, "shingle", "__m", total).withColumn("other", F.explode("hubs")).filter(may_link(similarity)))))
    component = cut(connected_components(links, "a", "b"))
    classes = cut(_classes(each, component))
    classed = cut(attach(shared, classes, "fp", "__w", total).drop("__w"))
    apart = cut(classed.groupBy("shingle").agg(F.count("*").alias("__m"), F.min("class").alias("x"), F.max("class").alias("y")).filter("x <> y").select("shingle", "__m"))
    rest = cut(attach(classed, apart, "shingle", "__m", total).drop("__m"))
    if rest.take(1):
        others = rest.select(F.col("shingle").alias("__shingle"), F.struct("fp", "size", "pos", "class").alias("other"))
        more = rest.join(others, (F.col("shingle") == F.col("__shingle")) & (F.col("class") < F.col("other.class")) & may_link(similarity))
        component = cut(connected_components(links.unionByName(check(ordered(more))), "a", "b"))
    joined = _classes(points.select("fp", "rep", "__n"), component)
    least = joined.groupBy("class").agg(F.min("rep").alias("component_id"))
    known = cut(joined.join(least, "class").select("fp", "__n", "component_id"))
    return attach(rows.select("doc_id", "fp"), known, "fp", "__n", rows.count()).select("doc_id", "fp", "component_id")
