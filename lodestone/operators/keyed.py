"""Joins of a fact side with a table that has one row per key, which is small or has keys that hold a large share of the facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot above this share of all fact rows, so there are at most 1 / HOT_SHARE hot keys, whatever the data.
HOT_SHARE = 1 / 512
#: Below so many rows a key is never hot.
HOT_ROWS = 1000
#: Rows of a dimension, such as a table of types, that are broadcast at most.
DIMENSION_ROWS = 10_000


def dimension(table: DataFrame, rows: int = DIMENSION_ROWS) -> DataFrame:
    """``table`` for a join: marked to be broadcast if it has at most ``rows`` rows, which are counted; as it is otherwise."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def attach(facts: DataFrame, table: DataFrame, key: str, weight: str, total: int, table_key: str | None = None, how: str = "inner") -> DataFrame:
    """``facts`` with the columns of ``table`` on equal, non-null ``key`` (``how``: inner or left join); ``table`` has one row per key.

    ``weight`` is the column of ``table`` with the number of fact rows of its key, ``total`` the number of fact
    rows. Hot keys, of which there are at most 512, are broadcast; the rest meet in a shuffled join in which no
    key has more than ``max(HOT_ROWS, total / 512)`` rows. ``weight`` stays among the columns. Both sides are
    read twice, so pass materialised ones.
    """
    least = max(HOT_ROWS, int(total * HOT_SHARE))
    table_key = table_key or key
    table = table.withColumnRenamed(table_key, "__key")
    hot = table.filter(F.col(weight) > least)
    cold = table.filter(F.col(weight) <= least)
    on = facts[key] == F.col("__key")
    if total <= least:
        return facts.join(table, on, how).drop("__key")
    direct = facts.join(F.broadcast(hot), on).drop("__key")
    rest = facts.join(F.broadcast(hot.select("__key")), on, "left_anti").join(cold, on, how).drop("__key")
    return direct.unionByName(rest)
