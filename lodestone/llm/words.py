"""What all operators here call a word: a run of characters other than the six ASCII white-space ones."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"


#: Rows that a worker turns to Python objects at once; Arrow's batches have 10,000.
SLICE_ROWS = 256


def slices(batches: Iterable, rows: int = SLICE_ROWS) -> Iterator:
    """Parts of record batches, so that a worker holds the strings and results of a few rows at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


#: Rows of one or two numbers that are broadcast at most, about 16 MB as a hash table.
BROADCAST_ROWS = 300_000


def bounded(ids: DataFrame) -> DataFrame:
    """``ids`` (materialised rows of one or two numbers) for a join: broadcast if they are few, shuffled otherwise."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def word_array(text: Column) -> Column:
    """The words of ``text`` in order; none for an empty text."""
    return let(F.btrim(text, F.lit(SPACES)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "[\\x20\\x09-\\x0D]+")))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def without(text: Column, characters: str) -> Column:
    """``text`` less every one of ``characters``."""
    return F.translate(text, characters, "")
