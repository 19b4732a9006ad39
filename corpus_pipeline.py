"""From raw documents to token ids: quality rules, exact dedup, near dedup, mixing, encoding."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import bpe, exact, mixing, quality, simhash
from lodestone.session import shared_dir

#: Each takes (spark, docs, folder of the tables); all but the last return the columns of documents.
STAGES = [
    ("quality_rules", quality.keep),
    ("exact_dedup", exact.keep),
    ("simhash_near_dedup", simhash.keep),
    ("source_mixing", mixing.mix_documents),
    ("bpe_encoding", bpe.encode_stage),
]
#: No SQL: SimHash components and byte-pair merges are iterative. tests/llm checks run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written to the shared folder and read again for the next."""
    home = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return made
        made.write.parquet(f"{home}/{k}-{name}")
        docs = spark.read.parquet(f"{home}/{k}-{name}")
    return docs
