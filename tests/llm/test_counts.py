"""Quality, exact dedup, tokens and codec against plain Python and the libraries."""

import base64
import collections
import hashlib
import re

import pytest

pytest.importorskip("lodestone.llm")
import public_tokenizers as P  # noqa: E402
import tiktoken  # noqa: E402
from cases import awkward, documents, empty  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from lodestone.llm import bpe, exact, quality  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_quality(text):
    t = text or ""
    w = WORD.findall(t)
    windows = list(zip(w, w[1:], w[2:], strict=False))
    n = collections.Counter(windows)
    covered = {j for i, x in enumerate(windows) if n[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n_rep = len(covered)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), n_rep, len(w) < 50 or 100 * n_rep > 50 * len(w)


@pytest.mark.parametrize("make", [awkward, documents, empty])
def test_quality(spark, make):
    docs = make(spark)
    q = F.col("__quality")
    got = quality.judge(docs).select("doc_id", "text", *[q.getField(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "__base_failed", "__kept").collect()
    assert len(got) == docs.count()
    for r in got:
        assert tuple(r)[2:8] == brute_quality(r.text)
        assert not (r["__kept"] and r["__base_failed"])
    assert quality.keep(spark, docs, "").columns == docs.columns


def test_quality_has_no_longest_text(spark):
    """A text of 1.2 million words is judged by its ratios like any other."""
    words = [f"{w}{i}" if i % 7 else "the" for i, w in enumerate(["word", "other", "thing"] * 400_000)]
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id bigint, text string")
    assert quality.keep(spark, docs, "").count() == 1


def test_quality_keeps_what_is_labelled_good(spark):
    from cases import FOLDER

    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = quality.judge(documents(spark)).join(labels, "doc_id").select("quality", "__kept", "__base_failed").collect()
    good = [r for r in rows if r.quality == 1 and not r["__base_failed"]]
    bad = [r for r in rows if r.quality == 0]
    assert all(r["__kept"] for r in good)
    assert not any(r["__kept"] for r in bad)


def brute_exact(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append((-len(t or ""), i is None, i or 0, i))
    return {k: (min(g)[3], len(g)) for k, g in groups.items()}, norm


@pytest.mark.parametrize("make", [awkward, documents, empty])
def test_exact(spark, make):
    docs = make(spark)
    rows = exact.digest_rows(docs)
    got = exact.dedup(rows, exact._fresh_index(spark, 1)).collect()
    source = [(r.doc_id, r.text) for r in docs.collect()]
    groups, norm = brute_exact(source)
    want = collections.Counter((i, hashlib.sha256(norm(t).encode()).hexdigest(), *groups[norm(t)]) for i, t in source)
    assert collections.Counter((r.doc_id, r.digest, r.keep_id, r.group_size) for r in got) == want
    left = exact.keep(spark, docs, "")
    assert left.columns == docs.columns
    left = left.collect()
    assert len(left) == len(groups) and len({norm(r.text) for r in left}) == len(groups)
    for r in left:
        assert groups[norm(r.text)][0] == r.doc_id


def test_index_persists(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    first = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "c")], "doc_id bigint, text string")
    index = exact.DigestIndex.open(spark, path, 4)
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact.dedup(exact.digest_rows(first), index).collect()}
    assert got == {1: (1, True), 2: (1, False), 3: (3, True)}
    again = exact.DigestIndex.open(spark, path, 4)
    second = spark.createDataFrame([(7, "c "), (8, "d")], "doc_id bigint, text string")
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact.dedup(exact.digest_rows(second), again).collect()}
    assert got == {7: (3, False), 8: (8, True)}
    assert exact.DigestIndex.open(spark, path, 4).table().count() == 3
    plan = again.unseen(exact.groups_of(exact.digest_rows(second)))._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "SelectedBucketsCount: 4 out of 4" in plan


def test_index_order_is_used(spark, tmp_path):
    """After appends the index is never shuffled; after a compaction it is not sorted either, and holds the same rows."""
    index = exact.DigestIndex.open(spark, f"file://{tmp_path}/index", 4)
    batch = lambda lo, hi: exact.groups_of(exact.digest_rows(spark.range(lo, hi).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))))
    plan = lambda: index.unseen(batch(0, 5))._jdf.queryExecution().executedPlan().toString()
    for k in range(3):
        assert index.admit(batch(100 * k, 100 * k + 150)).count() == (150 if k == 0 else 100)
    appended, before = plan(), sorted(map(tuple, index.table().collect()))
    index.compact()
    compacted = plan()
    assert len(before) == 350 and sorted(map(tuple, index.table().collect())) == before
    count = lambda p, what: len(re.findall(rf"\b{what}\b", p))
    assert count(compacted, "Exchange") == count(appended, "Exchange") and count(compacted, "Sort") == count(appended, "Sort") - 1
    assert index.unseen(batch(0, 400)).count() == 50
    index.COMPACT_AFTER = 2
    assert index.admit(batch(300, 400)).count() == 50 and index.version == 2 and index.table().count() == 400
    index.drop()
    assert not (tmp_path / "index").exists()


@pytest.mark.parametrize("make", [awkward, documents, empty])
def test_token_counts(spark, make):
    docs = make(spark)
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = bpe.count_tokens(docs, P.path("byte_bpe_50k.json")).collect()
    texts = [r.text or "" for r in docs.collect()]
    want = [len(x.ids) for x in t.encode_batch(texts, add_special_tokens=False)]
    assert sorted((r.n_bytes, r.n_tokens) for r in got) == sorted(zip((len(x.encode()) for x in texts), want, strict=True))
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)


def test_whole_tokens_are_proven():
    spec = bpe.read_merges(P.path("byte_bpe_50k.json"))
    whole = bpe.prove_whole(spec["merges"], spec["vocabulary"])
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert 45_000 < len(whole) < len(spec["vocabulary"]) and "<|endoftext|>" not in whole
    for piece in list(whole)[:2000]:
        if len(t.pre_tokenizer.pre_tokenize_str(piece)) == 1:
            assert len(t.encode(piece, add_special_tokens=False).ids) == 1


def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def codec():
    return bpe.Codec({"ranks": bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), "pattern": P.PATTERN})


def test_every_code_point_splits_as_in_the_libraries():
    e, c = encoding(), codec()
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    counter = bpe.TokenCounter(bpe.read_merges(P.path("byte_bpe_50k.json")) | {"pattern": P.PATTERN, "whole": {}})
    points = [p for p in range(0x30000) if not 0xD800 <= p < 0xE000]
    odd = []
    for at in range(0, len(points), 512):
        text = "".join(f"a{chr(p)}1 {chr(p)}{chr(p)} 'S" for p in points[at : at + 512])
        if c.encode(text) != b"".join(i.to_bytes(4, "little") for i in e.encode_ordinary(text)) or counter(text) != len(t.encode(text, add_special_tokens=False).ids):
            odd.append(at)
    assert not odd


@pytest.mark.parametrize("size,overlap", [(65_536, 1024), (32_768, 1024), (50, 16), (7, 4)])
def test_round_trip(spark, size, overlap):
    e = encoding()
    docs = awkward(spark)
    if size == 7:
        docs = docs.filter("length(text) < 2000 OR text IS NULL")
    got = bpe.round_trip(docs, P.path("byte_bpe_50k.tiktoken"), size=size, overlap=overlap).collect()
    want = [(r.doc_id, b"".join(i.to_bytes(4, "little") for i in e.encode_ordinary(r.text or "")), (r.text or "").encode()) for r in docs.collect()]
    key = lambda r: (str(r[0]), r[1])
    assert sorted(((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in got), key=key) == sorted(want, key=key)


def test_round_trip_documents(spark):
    e = encoding()
    for make in (documents, empty):
        docs = make(spark)
        want = {r.doc_id: (len(ids := e.encode_ordinary(r.text)), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()) for r in docs.collect()}
        assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(bpe.round_trip(docs, P.path("byte_bpe_50k.tiktoken"))).collect()} == want


def test_stitching_random_texts():
    import random

    rng, c = random.Random(3), codec()
    for _ in range(300):
        text = "".join(rng.choice(["a", "b", " ", "  ", "\n", "'", "'re", "1", "!", "é", "aaaaaaaa", "   \n  "]) for _ in range(rng.randint(0, 120)))
        for size, overlap in ((5, 3), (11, 6), (40, 8)):
            parts = bpe.chunks_of(text, size, overlap)
            chunks = [(s, x, [s + b for b in c.bounds(x, k == len(parts) - 1)]) for k, (s, x) in enumerate(parts)]
            assert [p for ps in bpe.stitch(chunks, c) for p in ps] == c.pieces(text)


def test_long_and_short_merges_agree():
    c = codec()
    e = encoding()
    for text in ("ab" * 400, "a" * 1000, "the" * 300, "é" * 200):
        assert c.encode(text) == b"".join(i.to_bytes(4, "little") for i in e.encode_ordinary(text))
