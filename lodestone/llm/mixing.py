"""Mixing sources to target weights by Efraimidis-Spirakis sampling under token budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.words import SPACES, table, text_or_empty, without, word_count
from lodestone.session import cut

#: Weights of the sources in code-point order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: A source gives at most so many times its own size.
CAP = 3
#: Rows of a source that are sorted together, about.
CELL_ROWS = 512
SEED = "mix-1"
#: The plan, of one row per source, is broadcast up to so many sources (about 10 MB), and joined by shuffle beyond.
BROADCAST_SOURCES = 50_000


def quality_weight(size: Column, text: Column) -> Column:
    """1 for texts without symbols, less with more symbols a word, never 0."""
    symbols = F.length(text) - F.length(without(text, "#*$%&|<>"))
    return F.lit(1.0) / (F.lit(1.0) + F.coalesce(F.try_divide(symbols.cast("double"), size.cast("double")), F.lit(0.0)))


def sampling_key(doc_id: Column, weight: Column, seed: str = SEED) -> Column:
    """-ln(u) / weight with u in (0, 1) from the document's id; the least keys are drawn first."""
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 13), 16, 10)
    u = (digits.cast("double") + F.lit(0.5)) / F.lit(float(2**52))
    return -F.ln(u) / weight


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``__size`` (words), ``__key`` and the source as (``__none``, ``__source``), so that null is a source."""
    df = docs.withColumn("__size", word_count(text_or_empty(text)))
    df = df.withColumn("__key", sampling_key(F.col("doc_id"), quality_weight(F.col("__size"), text_or_empty(text))))
    return df.withColumns({"__none": F.col("source").isNull(), "__source": F.coalesce(F.col("source").cast("string"), F.lit(""))})


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP) -> DataFrame:
    """``sizes`` (__none, __source, source_size: one row per source) with ``target``.

    The total is shared by weight; what exceeds cap times a source's size is reshared among the others by
    weight, until none is above. In closed form: with sources in order of cap * size / weight, those are capped
    whose bound is within the share that is left for them. One row per source is sorted in one task.
    """
    place = (F.row_number().over(Window.orderBy("__none", "__source")) - 1) % len(weights)
    df = sizes.withColumn("__w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1)).withColumn("__most", F.col("source_size").cast("double") * F.lit(float(cap)))
    order = Window.orderBy(F.col("__most") / F.col("__w"), "__none", "__source")
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("__most").over(before), F.lit(0.0))
    weight_left = F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(before), F.lit(0.0))
    df = df.withColumn("__share", left / weight_left).withColumn("__full", F.col("__most") <= F.col("__share") * F.col("__w"))
    level = F.max(F.when(~F.col("__full"), F.col("__share"))).over(everything)
    return df.withColumn("target", F.when(F.col("__full"), F.col("__most")).otherwise(level * F.col("__w"))).select("__none", "__source", "source_size", "target")


def plan(base: DataFrame, rows: int, weights: tuple = WEIGHTS, cap: float = CAP) -> DataFrame:
    """One row per source: target, complete epochs, and the document at which the fractional epoch's budget ends.

    ``base`` has doc_id, __none, __source, __size, __key and is read several times. Keys fall into cells that are in
    order; sizes are summed per cell, and only the cell in which a budget ends is sorted, so that a source with
    any share of all rows never meets in one task.
    """
    cells = max(1, min(1 << 24, rows // CELL_ROWS))
    source = ["__none", "__source"]
    base = base.withColumn("__cell", F.floor(F.col("__key") / (F.col("__key") + 1) * cells))
    per = cut(base.groupBy(*source, "__cell").agg(F.sum("__size").alias("s")))
    sized = cut(targets(per.groupBy(*source).agg(F.sum("s").alias("source_size")), weights, cap))
    budget = F.floor(F.col("target") + 0.5)
    sized = sized.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.least(budget.cast("double") / F.col("source_size"), F.lit(float(cap))))).otherwise(0).cast("long"))
    sized = sized.withColumn("__left", F.when(F.col("source_size") > 0, budget - F.col("epochs") * F.col("source_size")).otherwise(0).cast("long"))
    upto = Window.partitionBy(*source).orderBy("__cell").rowsBetween(Window.unboundedPreceding, 0)
    last = per.withColumn("__upto", F.sum("s").over(upto)).join(sized.select(*source, "__left"), source).filter("__left > 0 AND __upto - s < __left AND __left <= __upto").withColumn("__left", F.col("__left") - (F.col("__upto") - F.col("s"))).select(*source, "__cell", "__left")
    order = Window.partitionBy(*source).orderBy("__key", F.col("doc_id").asc_nulls_last(), "__size").rowsBetween(Window.unboundedPreceding, 0)
    ties = base.join(last, [*source, "__cell"]).groupBy(*source, "__key", "doc_id", "__size").agg(F.count("*").alias("__n"), F.first("__left").alias("__left"))
    at = ties.withColumn("__upto", F.sum(F.col("__size") * F.col("__n")).over(order)).filter("__upto >= __left AND __upto - __size * __n < __left")
    at = at.select(*source, F.struct("__key", F.col("doc_id").isNull().alias("none"), "doc_id", "__size").alias("__at"), F.floor((F.col("__left") - (F.col("__upto") - F.col("__size") * F.col("__n"))) / F.col("__n")).alias("__part"))
    return cut(sized.join(at, source, "left"))


def apply(docs: DataFrame, planned: DataFrame) -> DataFrame:
    """``docs`` (from keyed()) with ``size, source_size, target, epochs, taken`` of each row; nothing but the plan is joined."""
    me = F.struct("__key", F.col("doc_id").isNull().alias("none"), "doc_id", "__size")
    extra = F.when(F.col("__at").isNull(), 0).when(me < F.col("__at"), F.col("__size")).when(me == F.col("__at"), F.col("__part")).otherwise(0)
    few = planned.count() <= BROADCAST_SOURCES
    joined = docs.join(F.broadcast(planned) if few else planned, ["__none", "__source"])
    return joined.withColumn("size", F.col("__size")).withColumn("taken", (F.col("epochs") * F.col("__size") + F.coalesce(extra, F.lit(0))).cast("long"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP) -> tuple[DataFrame, DataFrame]:
    """(rows, plan): ids with what the mix takes of each, and the plan, to be applied to whole documents."""
    base = cut(keyed(docs).select("doc_id", "__none", "__source", "__size", "__key"))
    planned = plan(base, base.count(), weights, cap)
    return apply(base, planned), planned


def op1_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix takes of every document."""
    rows, _ = mix(table(spark, folder, "documents").select("doc_id", "text", "source"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def mix_documents(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline stage: a row per copy that the mix takes of a document.

    Complete epochs give whole copies. The fractional epoch gives a whole copy of each document drawn, and at the end of
    a source's budget the part of one document that still fits, with its own spacing. Documents of which nothing is
    taken go, and so do those without a word.
    """
    _, planned = mix(docs.select("doc_id", "text", "source"))
    carried = keyed(docs).select("doc_id", "__none", "__source", "__size", "__key", F.struct(*[F.col(c) for c in docs.columns]).alias("__row"))
    taken = apply(carried, planned).filter("taken > 0").select("__row", "taken", "size")
    copies = taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    words = F.least(F.col("size"), F.col("taken") - (F.col("__copy") - 1) * F.col("size"))
    whole = F.col("__row.text")
    cut_text = F.array_join(F.slice(F.split(F.btrim(whole, F.lit(SPACES)), "(?<=[\\x20\\x09-\\x0D])(?=[^\\x20\\x09-\\x0D])"), 1, words.cast("int")), "")
    text = F.when(words < F.col("size"), cut_text).otherwise(whole)
    made = {"text": text, "n_chars": F.when(words < F.col("size"), F.length(text).cast("long")).otherwise(F.col("__row").getField("n_chars"))} if "n_chars" in docs.columns else {"text": text}
    return copies.select(*[made.get(c, F.col("__row").getField(c)).alias(c) for c in docs.columns])


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS symbols FROM documents
), k AS (
  SELECT *, -ln((('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / (1.0 / (1.0 + CASE WHEN size > 0 THEN symbols::DOUBLE / size ELSE 0.0 END)) AS key FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, ([5.0, 2.0, 1.0])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source
), o AS (
  SELECT *, 3.0 * source_size AS most, sum(source_size::DOUBLE) OVER () - coalesce(sum(3.0::DOUBLE * source_size) OVER before, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS weight_rest
  FROM s WINDOW before AS (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (
  SELECT *, most <= rest / weight_rest * w AS full_up, max(CASE WHEN most > rest / weight_rest * w THEN rest / weight_rest END) OVER () AS level FROM o
), t AS (
  SELECT source, source_size, (CASE WHEN full_up THEN most ELSE level * w END)::DOUBLE AS target FROM c
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(least(floor(target + 0.5) / source_size, 3.0))::BIGINT ELSE 0 END AS epochs FROM t
), r AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, floor(e.target + 0.5)::BIGINT - e.epochs * e.source_size AS left_over, sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS UNBOUNDED PRECEDING) - k.size AS before
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target, (epochs * size + least(size, greatest(0, left_over - before)))::BIGINT AS taken FROM r
"""
