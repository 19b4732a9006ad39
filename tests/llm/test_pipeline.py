"""The pipeline against plain Python, stage by stage, and its awkward inputs."""

import collections
import hashlib
import re

import pytest

pytest.importorskip("lodestone.llm")
import corpus_pipeline  # noqa: E402
from cases import awkward, documents, empty  # noqa: E402
from test_counts import brute_exact, brute_quality, encoding  # noqa: E402
from test_groups import water_fill  # noqa: E402
from test_similar import brute_kept  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_are_listed_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "simhash_near_dedup", "source_mixing", "bpe_encoding"]


@pytest.mark.parametrize("make", [awkward, documents, empty])
def test_stage_by_stage(spark, make, tmp_path):
    docs = make(spark)
    e = encoding()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        made = stage(spark, docs, "")
        if k < 4:
            assert made.columns == docs.columns
        made.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = docs.collect()
        if k == 0:
            passed = [r for r in before if not brute_quality(r.text)[5]]
            assert not collections.Counter(map(str, after)) - collections.Counter(map(str, passed))
            assert len(after) >= 0.8 * len(passed)
        if k == 1:
            groups, norm = brute_exact([(r.doc_id, r.text) for r in before])
            assert len(after) == len(groups) == len({norm(r.text) for r in after})
        if k == 2 and all(r.doc_id is not None for r in before):
            assert sorted(r.doc_id for r in after) == brute_kept([(r.doc_id, r.text) for r in before])
        if k == 3:
            assert collections.Counter(r.doc_id for r in after).keys() <= {r.doc_id for r in before}
            sizes, taken = collections.Counter(), collections.Counter()
            for r in before:
                sizes[r.source] += len(WORD.findall(r.text))
            for r in after:
                taken[r.source] += len(WORD.findall(r.text))
            for source, target in (water_fill(dict(sizes)) if sizes else {}).items():
                assert abs(taken[source] - target) <= 2
        if k == 4:
            want = collections.Counter((r.doc_id, len(ids := e.encode_ordinary(r.text)), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()) for r in before)
            assert collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in after) == want


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert out and {r.doc_id for r in out} <= {r.doc_id for r in documents(spark, "/root/testdata/sf0.001").collect()}
