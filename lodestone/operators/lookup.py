"""Lookups of single things and of what refers to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_key(df: DataFrame, value, key: str = "id") -> DataFrame:
    """At most one row with this key; the filter reaches the scan."""
    return df.filter(F.col(key) == value).limit(1)


def has(df: DataFrame, value, key: str = "id") -> bool:
    return bool(by_key(df, value, key).take(1))


def relationships_of(relationships: DataFrame, ref: str, direction: str = "both") -> DataFrame:
    """Relationships (from_id, to_id) at ``ref``: outgoing, incoming or both."""
    out, into = F.col("from_id") == ref, F.col("to_id") == ref
    return relationships.filter({"outgoing": out, "incoming": into, "both": out | into}[direction])


def references_object(references: Column, target: str) -> Column:
    """Whether an array of references names an object."""
    return F.exists(references, lambda r: (r.getField("ref") == target) & (r.getField("kind") == "knowledge_object"))


def primary_source(sources: Column) -> Column:
    """The first source, or null."""
    return F.try_element_at(sources, F.lit(1))


def _postings(nodes: DataFrame) -> DataFrame:
    """(id, attribute, value), each once."""
    p = lambda k: F.col(f"properties.{k}")
    pairs = F.concat(
        F.transform("labels", lambda t: F.struct(F.lit("tag").alias("a"), t.alias("v"))),
        F.array(*[F.struct(F.lit(a).alias("a"), c.alias("v")) for a, c in (("type", F.col("type")), ("domain", p("domain")), ("source", p("source")), ("lifecycle", p("lifecycle")), ("project_id", p("project_id")))]),
    )
    return nodes.select("id", F.explode(pairs).alias("x")).filter("x.v <> ''").distinct().select("id", F.col("x.a").alias("attribute"), F.col("x.v").alias("value"))


def posting_lists(nodes: DataFrame) -> DataFrame:
    """(attribute, value, ids): the nodes of each value of the attributes that queries filter by.

    For inspection: queries filter the nodes themselves. A value that most nodes share has a list of as many ids.
    """
    return _postings(nodes).groupBy("attribute", "value").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def posting_sizes(nodes: DataFrame) -> DataFrame:
    """(attribute, value, n) without the lists: counts that are added up before the shuffle."""
    return _postings(nodes).groupBy("attribute", "value").agg(F.count("*").alias("n"))


def type_registry(dimension: DataFrame, more: DataFrame) -> DataFrame:
    """A dimension of types with rows added; of equal ids the added one stands."""
    return more.unionByName(dimension.join(more.select("id"), "id", "left_anti"), allowMissingColumns=True)
