"""Catalogs and graphs as JSONL, JSON and YAML: records of the form {"kind": ..., "data": {...}}."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Kinds in the order in which they are written; each is a relation.
KINDS = {"KnowledgeType": "types", "RelationshipType": "relationship_types", "EvidenceType": "evidence_types", "KnowledgeObject": "objects", "KnowledgeRelationship": "relationships", "metadata": "metadata"}


def records(df: DataFrame, kind: str) -> DataFrame:
    """(value) lines of one relation; nulls are kept as such."""
    return df.select(F.to_json(F.struct(F.lit(kind).alias("kind"), F.struct(*df.columns).alias("data")), {"ignoreNullFields": "false"}).alias("value"))


def catalog_lines(catalog: dict[str, DataFrame]) -> DataFrame:
    """(value, part): lines of all relations of a catalog, in the order of KINDS by part."""
    parts = [records(catalog[name], kind).withColumn("part", F.lit(i)) for i, (kind, name) in enumerate(KINDS.items()) if name in catalog]
    return reduce(DataFrame.unionByName, parts)


def write_jsonl(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Lines (value, part optional) as text files; within a write, parts follow each other."""
    ordered = lines.orderBy("part").select("value") if "part" in lines.columns else lines.select("value")
    ordered.write.mode(mode).text(path)


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Records of a JSONL file; blank lines are skipped. A missing file is an empty relation if its schema is given."""
    if schema is not None and not _exists(spark, path):
        return spark.createDataFrame([], schema)
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*") if schema else lines


def read_catalog(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """Relations of a catalog; of records with the same id the last in the file wins; an unknown kind raises.

    ``schemas``: DDL text by relation. Every relation is a filter and a projection over one scan of the lines.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "").withColumn("seq", F.monotonically_increasing_id())
    parsed = lines.select("seq", F.get_json_object("value", "$.kind").alias("kind"), F.get_json_object("value", "$.data").alias("data"))
    odd = parsed.filter(F.col("kind").isNull() | ~F.col("kind").isin(list(KINDS))).select("kind").first()
    if odd:
        raise ValueError(f"unknown kind of record: {odd.kind}")
    out = {}
    for kind, name in KINDS.items():
        if name not in schemas:
            continue
        rows = parsed.filter(F.col("kind") == kind).select("seq", F.from_json("data", schemas[name]).alias("r")).select("seq", "r.*")
        if "id" in rows.columns:
            latest = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("seq")))
            rows = rows.withColumn("__n", latest).filter("__n = 1").drop("__n")
        out[name] = rows.drop("seq")
    return out


def to_json(df: DataFrame, most: int = 100_000) -> str:
    """A small relation as an indented JSON array; more than ``most`` rows raise."""
    return json.dumps(_small(df, most), indent=2, ensure_ascii=False)


def to_yaml(df: DataFrame, most: int = 100_000) -> str:
    import yaml

    return yaml.safe_dump(_small(df, most), sort_keys=False, allow_unicode=True)


def _small(df: DataFrame, most: int) -> list:
    rows = [json.loads(r) for (r,) in df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"over {most} rows; write them with write_jsonl()")
    return rows


def from_text(spark: SparkSession, text: str, schema: str, form: str = "json") -> DataFrame:
    """Rows of a JSON or YAML array (or of one object)."""
    if form == "yaml":
        import yaml

        data = yaml.safe_load(text)
    else:
        data = json.loads(text)
    data = data if isinstance(data, list) else [data]
    lines = spark.createDataFrame([(json.dumps(x, default=str),) for x in data], "value string")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def graph_from_jsonl(spark: SparkSession, path: str, nodes: str, edges: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of what graph.jsonl_lines() wrote; undirected edges are undirected again."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    part = lambda kind, schema: lines.filter(F.get_json_object("value", "$.kind") == kind).select(F.from_json(F.get_json_object("value", "$.data"), schema).alias("r")).select("r.*")
    return part("node", nodes), part("edge", edges)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


#: Files of each profile of a saved graph; any other name saves all.
PROFILES = {"graph": ("graph.jsonl", "graph.dot", "graph.cypher"), "knowledge": ("graph_nodes.jsonl", "graph_edges.jsonl")}


def save_graph(nodes: DataFrame, edges: DataFrame, folder: str, profile: str = "all") -> list[str]:
    """Write a graph's text forms as folders of part files below ``folder``; returns their names."""
    from lodestone.engine import Engine

    names = PROFILES.get(profile) or tuple(n for p in PROFILES.values() for n in p)
    for name in names:
        Engine.graph_lines(nodes, edges, name).write.mode("overwrite").text(f"{folder}/{name}")
    return list(names)
