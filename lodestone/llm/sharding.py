"""Shards of near-equal bytes by sampled splitters, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.words import table, text_or_empty
from lodestone.session import cut

SHARDS = 8
#: Rows of a range, about; a range of over twice as many is subdivided.
RANGE_ROWS = 20_000
#: Sampled keys per splitter, and the most splitters that one round draws. Together they bound what the driver gets: 7 MB of keys.
PER_SPLITTER, MAX_SPLITTERS = 16, 4096
#: The law's tolerance: a shard's bytes may be off by this share of a shard. A group of equal texts of up to that size stays in one
#: shard, as it moves each border by half of itself at most; a larger group is divided, since sizes must stay near equal.
TOLERANCE = 0.01


def _hex(x: Column) -> Column:
    return F.lpad(F.hex(x), 16, "0")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, group, key): key orders rows by text, then by a hash of the id, then by a number of the row; group is the text's part of it.

    No two rows share a key, so that any range can be divided.
    """
    text = text_or_empty()
    df = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), _hex(F.xxhash64(text)).alias("group"))
    by_id = F.xxhash64(F.lit(6), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return df.withColumn("key", F.concat("group", _hex(by_id), _hex(F.monotonically_increasing_id())))


def _range_of(key: Column, splitters: list[str]) -> Column:
    """Number of ``splitters`` (in order) that are at most ``key``: a binary search of log2(splitters) steps."""
    if not splitters:
        return F.lit(0)
    steps, n = [], 1
    while n <= len(splitters):
        steps.insert(0, n)
        n *= 2
    keys = F.array(*[F.lit(s) for s in splitters]) if len(splitters) < 2 else F.split(F.lit(",".join(splitters)), ",")
    found = lambda at, step: F.when((at + step <= len(splitters)) & (F.get(keys, at + step - 1) <= key), at + step).otherwise(at)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), found)


def _sample(rows: DataFrame, share: float, total: int, what: str) -> list[str]:
    """Distinct ``what`` of rows drawn with a chance of about ``share`` * size, by a hash of the key: reruns agree."""
    chance = F.least(F.lit(1.0), F.col("size") / F.lit(float(total)) * F.lit(share))
    u = F.pmod(F.xxhash64(F.lit(66), "key"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = rows.filter(u < chance).select(F.col(what).alias("k")).distinct().orderBy(F.xxhash64("k")).limit(2 * PER_SPLITTER * MAX_SPLITTERS)
    return sorted(r.k for r in drawn.collect())


def splitters(base: DataFrame, rows: int, size: int) -> list[str]:
    """Keys that divide the rows into ranges: quantiles of a size-weighted sample, then more of them where a range is overfull.

    The first round's splitters lie between groups of equal texts. A range that is still overfull, as one group fills
    it, is subdivided within the group. Each round draws a bounded sample.
    """
    n = max(SHARDS * 4, min(MAX_SPLITTERS, rows // RANGE_ROWS))
    sample = _sample(base, float(n * PER_SPLITTER), max(size, 1), "group")
    chosen = sorted({sample[i * len(sample) // n] for i in range(1, n) if sample})
    for what in ("group", "key", "key"):
        counted = base.withColumn("range", _range_of(F.col("key"), chosen)).groupBy("range").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
        full = {r.range: (r.n, r.s) for r in counted.filter(F.col("n") > 2 * RANGE_ROWS).orderBy(F.desc("n")).limit(MAX_SPLITTERS).collect()}
        if not full:
            break
        inside = base.withColumn("range", _range_of(F.col("key"), chosen)).filter(F.col("range").isin(list(full)))
        parts = min(MAX_SPLITTERS, sum(c // RANGE_ROWS for c, _ in full.values()))
        sample = _sample(inside, float(parts * PER_SPLITTER), sum(s for _, s in full.values()), what)
        chosen = sorted({*chosen, *(sample[i * len(sample) // parts] for i in range(1, parts) if sample)})
    return chosen


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): shards of near-equal bytes; slots count from 0 in each shard without gaps.

    Rows are in the order of ``key``; a row's shard is where the middle of its bytes, or of its group's if the group is
    within TOLERANCE, lies among ``shards`` equal parts of all bytes. So a border is off by at most half of TOLERANCE of a shard, or
    half of the largest document. Size is the text's UTF-8 bytes plus 1 (null: 1). Within a range of
    about RANGE_ROWS rows sums run in order; ranges are added up by their totals, and so are groups that lie in several
    ranges, of which there are at most as many as splitters. Rows that repeat have slots of their own; an empty table gives no rows.
    """
    base = cut(keyed(docs))
    total = base.agg(F.count("*").alias("n"), F.sum("size").alias("s")).first()
    rows, size = total.n, total.s or 0
    base = cut(base.withColumn("range", _range_of(F.col("key"), splitters(base, rows, size))))
    ranges = cut(base.groupBy("range").agg(F.count("*").alias("range_n"), F.sum("size").alias("range_s")))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    ranges = ranges.select("range", F.coalesce(F.sum("range_n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("range_s").over(before), F.lit(0)).alias("s0"))
    order = Window.partitionBy("range").orderBy("key", F.col("doc_id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    same = Window.partitionBy("range", "group")
    placed = base.join(ranges, "range")
    placed = placed.withColumns({"upto": F.col("s0") + F.sum("size").over(order), "place": F.col("n0") + F.row_number().over(order) - 1})
    placed = cut(placed.withColumns({"group_s": F.sum("size").over(same), "group_end": F.max("upto").over(same)}))
    ends = placed.groupBy("range").agg(F.min("group").alias("a"), F.max("group").alias("b"))  # only a range's first and last group can go on in another one
    several = ends.select("range", F.explode(F.array_distinct(F.array("a", "b"))).alias("group")).groupBy("group").agg(F.count("*").alias("n")).filter("n > 1").select("group")
    several = cut(placed.join(F.broadcast(several), "group").groupBy("group").agg(F.sum("size").alias("all_s"), F.max("upto").alias("all_end")))
    placed = placed.join(F.broadcast(several), "group", "left").withColumns({"group_s": F.coalesce("all_s", "group_s"), "group_end": F.coalesce("all_end", "group_end")})
    whole = F.col("group_s") <= F.lit(TOLERANCE * size / shards)
    middle = F.when(whole, F.col("group_end") - F.col("group_s") / 2).otherwise(F.col("upto") - F.col("size") / 2)
    placed = cut(placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * F.lit(shards) / F.lit(float(max(size, 1)))).cast("int"))).select("doc_id", "size", "text_crc32", "shard", "place"))
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))  # one row per shard
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).cast("long").alias("slot"))


def op6_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All documents over eight shards by the law ``bytes``."""
    out = shard(table(spark, folder, "documents").select("doc_id", "text"))
    return out.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")}).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
