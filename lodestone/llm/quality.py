"""Quality rules: a table of thresholds compiled into one projection without user functions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.words import let, table, text_or_empty, without, word_array

SYMBOLS = "#*$%&|<>"
#: Frequent function words of the languages in view.
STOP_WORDS = (
    "the of and to in is that it for on as with was be by are this from at or an not but have "
    "der die das und in zu den ist von mit sich des auf für nicht ein eine dem als auch es an "
    "le la les de des et en un une du que qui dans pour par sur au est pas ce "
    "el los las y del se un una por con no su para al lo como más o"
).split()


@dataclass(frozen=True)
class Rule:
    """A document fails where ``measure`` is below ``least`` or above ``most`` (either may be None)."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: The verdict's thresholds; measures are the columns of measures(). Ratios are null, and pass, where their divisor is 0.
THRESHOLDS = (
    Rule("length", "n_words", 50, None),
    Rule("word_length", "mean_word_chars", 1.5, 30.0),
    Rule("symbols", "symbol_ratio", None, 0.1),
    Rule("stop_words", "stop_ratio", 0.01, None),
    Rule("duplicate_lines", "dup_line_ratio", None, 0.7),
    Rule("repeats", "repeat_ratio", None, 0.5),
)


def _covered(words: Column) -> Column:
    """Words that lie in a window of three that the text has twice or more.

    A window's hash only tells texts without any repeat apart, in which the answer is 0; where hashes repeat, the
    windows themselves are sorted with their places, so a collision cannot change the count. O(n log n).
    """

    def exact(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i")))

        def starts(s: Column) -> Column:
            same = lambda j, k: F.coalesce(F.get(s, k).getField("g") == F.get(s, j).getField("g"), F.lit(False))
            return F.filter(F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda j: F.when(same(j, j - 1) | same(j, j + 1), F.get(s, j).getField("i"))), lambda p: p.isNotNull())

        def step(state: Column, p: Column) -> Column:
            return F.struct((state.getField("n") + F.least(F.lit(3), p - state.getField("last"))).alias("n"), p.alias("last"))

        places = F.sort_array(let(F.sort_array(windows), starts))
        return F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), step, lambda s: s.getField("n"))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    repeats = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(F.when(repeats, exact(words)).otherwise(F.lit(0))).cast("long")


def measures(docs: DataFrame, text: str = "text", stop_words: tuple | list = STOP_WORDS) -> DataFrame:
    """``docs`` with the struct ``__quality`` of counts and ratios that rules may name, and ``__pin``.

    A null text counts as empty: all counts are 0, ratios null. No column of ``docs`` is changed. ``__pin`` is a row number that nothing
    depends on: a filter that names it is not pushed below this projection, where the measures would be computed once for each of their uses.
    """
    body = text_or_empty(text)
    has_word = f"[^{''.join(f'\\x{ord(c):02X}' for c in ' \t\n\x0b\x0c\r')}]"
    stop = [w for w in dict.fromkeys(stop_words)]

    def counts(w: Column) -> Column:
        lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(has_word))
        return let(
            lines,
            lambda ls: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(without(body, " \t\n\x0b\x0c\r")).cast("long").alias("word_chars"),
                (F.length(body) - F.length(without(body, SYMBOLS))).cast("long").alias("n_symbols"),
                F.size(ls).cast("long").alias("n_lines"),
                (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                _covered(w).alias("n_repeat_words"),
                F.size(F.filter(w, lambda x: F.lower(x).isin(stop))).cast("long").alias("n_stop_words"),
            ),
        )

    df = docs.withColumn("__counts", let(word_array(body), counts))
    c = lambda k: F.col("__counts").getField(k)
    ratio = lambda a, b: F.try_divide(c(a).cast("double"), c(b).cast("double"))
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words")
    ratios = {"mean_word_chars": ratio("word_chars", "n_words"), "symbol_ratio": ratio("n_symbols", "n_words"), "stop_ratio": ratio("n_stop_words", "n_words"), "dup_line_ratio": ratio("n_dup_lines", "n_lines"), "repeat_ratio": ratio("n_repeat_words", "n_words")}
    quality = F.struct(*[c(k).alias(k) for k in names], *[v.alias(k) for k, v in ratios.items()])
    return df.withColumns({"__quality": quality, "__pin": F.monotonically_increasing_id()}).drop("__counts")


def failures(rules: tuple[Rule, ...] = THRESHOLDS) -> Column:
    """Names of the rules that a row with ``__quality`` fails, in the table's order."""
    m = lambda r: F.col("__quality").getField(r.measure)
    bad = lambda r: reduce(lambda a, b: a | b, [x for x in (m(r) < r.least if r.least is not None else None, m(r) > r.most if r.most is not None else None) if x is not None], F.lit(False))
    return F.filter(F.array(*[F.when(bad(r), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())


def judge(docs: DataFrame, rules: tuple[Rule, ...] = THRESHOLDS, text: str = "text") -> DataFrame:
    """``docs`` with ``__quality`` (measures), ``__base_failed``, ``__failed`` (names of failed rules) and ``__kept``.

    base: under 50 words, or over half of the words in windows of three that repeat.
    """
    df = measures(docs, text)
    q = F.col("__quality")
    base = (q.getField("n_words") < 50) | (100 * q.getField("n_repeat_words") > 50 * q.getField("n_words"))
    df = df.withColumns({"__base_failed": base, "__failed": failures(rules)})
    return df.withColumn("__kept", ~F.col("__base_failed") & (F.size("__failed") == 0))


def op5_quality(spark, folder: str) -> DataFrame:
    """Counts and verdict of every document."""
    q = F.col("__quality")
    out = judge(table(spark, folder, "documents").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return out.select("doc_id", *[q.getField(k).alias(k) for k in names], F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"))


def keep(spark, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline stage: documents that pass; rows and columns are otherwise unchanged.

    Null and empty texts have no words and fail. Texts of any length are judged whole; repeated rows pass or fail alike. An empty table stays empty.
    """
    return judge(docs).filter("__kept AND __pin >= 0").select(*docs.columns)


OP5_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), l AS (
  SELECT doc_id, t, ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), r AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY doc_id
), m AS (
  SELECT l.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines, len(list_filter(ws, lambda x: list_contains([STOP], lower(x)))) AS n_stop
  FROM l LEFT JOIN r ON r.doc_id = l.doc_id
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars::DOUBLE / n_words BETWEEN 1.5 AND 30 AND n_symbols::DOUBLE / n_words <= 0.1 AND n_stop::DOUBLE / n_words >= 0.01 AND n_dup_lines::DOUBLE / n_lines <= 0.7 AND n_repeat_words::DOUBLE / n_words <= 0.5 AS kept
FROM f
""".replace("STOP", ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS)))
