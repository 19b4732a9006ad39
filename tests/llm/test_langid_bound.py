"""No language is dropped without a word."""

import pytest

pytest.importorskip("lodestone.llm")
from pyspark.sql import functions as F  # noqa: E402

from lodestone.llm import langid  # noqa: E402


def test_more_languages_than_the_bound_raise(spark, monkeypatch):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"), F.concat(F.lit("l"), (F.col("id") % 3).cast("string")).alias("lang"))
    monkeypatch.setattr(langid, "MAX_LANGS", 3)
    assert langid.sample_of(docs)[0] == ["l0", "l1", "l2"]
    monkeypatch.setattr(langid, "MAX_LANGS", 2)
    with pytest.raises(ValueError, match="more than 2 languages"):
        langid.sample_of(docs)
