"""Queries of the operators for training data, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from lodestone.llm import bpe, exact, langid, mixing, quality, sharding, simhash, toxicity, urls

QUERIES = {
    "op1_mix": mixing.op1_mix,
    "op2_simhash": simhash.op2_simhash,
    "op3_token_count": bpe.op3_token_count,
    "op4_bpe_codec": bpe.op4_bpe_codec,
    "op5_quality": quality.op5_quality,
    "op6_shards": sharding.op6_shards,
    "op7_exact_dedup": exact.op7_exact_dedup,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_langid": langid.op9_langid,
    "op10_url_filter": urls.op10_url_filter,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL = {"op1_mix": mixing.OP1_SQL, "op5_quality": quality.OP5_SQL, "op7_exact_dedup": exact.OP7_SQL, "op10_url_filter": urls.OP10_SQL}
