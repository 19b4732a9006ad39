"""Toxicity and language ID: held-out accuracy, the segment search, awkward inputs."""

import itertools
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("lodestone.llm")
from cases import awkward, documents, empty  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from lodestone.llm import langid, toxicity  # noqa: E402

LARGER = "/root/testdata/sf0.1"


def brute_segments(scores):
    """Ruzzo and Tompa by their definition: the maximal-scoring subsequence, then the same on both sides of it."""
    if not len(scores):
        return []
    best = None
    for a, b in itertools.combinations(range(len(scores) + 1), 2):
        total = sum(scores[a:b])
        if total > 1e-12 and (best is None or total > best[0] + 1e-12 or abs(total - best[0]) <= 1e-12 and b - a < best[2] - best[1]):
            best = (total, a, b)
    if best is None:
        return []
    total, a, b = best
    return brute_segments(scores[:a]) + [(a, b - 1, total)] + [(x + b, y + b, s) for x, y, s in brute_segments(scores[b:])]


def test_segments_are_maximal():
    rng = random.Random(5)
    for _ in range(200):
        gap = -rng.choice([0.5, 1.0, 2.0])
        scores = [gap if rng.random() < 0.6 else rng.choice([0.7, 1.3, 2.9]) for _ in range(rng.randint(0, 14))]
        got = toxicity.segments(np.array(scores), gap)
        want = brute_segments(scores)
        assert sum(s for _, _, s in got) == pytest.approx(sum(s for _, _, s in want))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]


def test_segments_in_linear_time():
    """Falling totals with many candidates on the stack: twice the hits take about twice the time, and a million take seconds."""
    import time

    spent = {}
    for n in (250_000, 1_000_000):
        scores = np.full(20 * n, -0.5)
        scores[::20] = 1.0
        began = time.process_time()
        assert len(toxicity.segments(scores, -0.5)) == n
        spent[n] = time.process_time() - began
    assert spent[1_000_000] < 20 and spent[1_000_000] < 10 * max(spent[250_000], 0.2)


def test_one_tokenizer():
    assert toxicity.words("Kill\u00a0Idiot\x0bÉTÉ  x\x1cy\n") == ["kill\u00a0idiot", "été", "x\x1cy"] and toxicity.words("") == []


def test_toxicity_by_brute_force(spark):
    """Token log-odds, the law's numbers and every score of short texts, by plain Python from the definitions."""
    import collections
    import math
    import re

    docs, labels = documents(spark, "/root/testdata/sf0.1").select("doc_id", "text"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.train(docs, labels)
    split = re.compile(r"[^ \t\n\x0b\x0c\r]+").findall
    sample = toxicity.sample_of(docs, labels).collect()
    n = {0: collections.Counter(), 1: collections.Counter()}
    for r in sample:
        if r.part < toxicity.COUNTED:
            per_word = {w: {w} | {w[:k] for k in toxicity.PREFIXES if len(w) > k} for w in set(split(r.text.lower()))}
            n[r.toxic].update(t for tokens in per_word.values() for t in tokens)
    total = {k: sum(c.values()) for k, c in n.items()}
    mass = max(toxicity.PRIOR * sum(total.values()), 1.0)
    want = {}
    for t in n[0].keys() | n[1].keys():
        prior = (n[0][t] + n[1][t]) / sum(total.values()) * mass
        a, b = n[1][t] + prior, n[0][t] + prior
        odds = math.log(a / (total[1] + mass - a)) - math.log(b / (total[0] + mass - b))
        if odds > 1 and odds / math.sqrt(1 / a + 1 / b) >= toxicity.LEAST_Z:
            want[t] = min(toxicity.MOST, odds)
    assert 0 < len(want) <= toxicity.MAX_TOKENS and model.scores.keys() == want.keys()
    assert all(math.isclose(model.scores[t], s, rel_tol=1e-9) for t, s in want.items())

    def found(text):
        w = split((text or "").lower())
        tokens = [[x, *(x[:k] for k in toxicity.PREFIXES)] for x in w]
        return len(w), [s for _, _, s in brute_segments([max((want[t] for t in ts if t in want), default=model.gap) for ts in tokens])]

    def evidence(length, scores):
        base = math.log(model.size * max(length, 1))
        x = sorted((model.rate * s - base for s in scores), reverse=True) or [-base]
        best, t = x[0], x[0]
        for r in range(2, len(x) + 1):
            if x[r - 1] <= 0:
                break
            t += x[r - 1]
            best = max(best, t - (r - 1) * math.log(max(t, 1)) + math.lgamma(r + 1) + math.lgamma(r) - (r - 1) * math.log(2))
        return best

    few = docs.filter("size(split(text, ' ')) <= 60").limit(60).unionByName(awkward(spark).filter("text IS NULL OR length(text) < 400").select("doc_id", "text"))
    rows = toxicity.score(few.union(few), model).collect()
    texts = collections.Counter()
    by_text = {}
    for r in few.collect():
        length, scores = found(r.text)
        z = model.slope * evidence(length, scores) + model.shift
        by_text[r.doc_id, r.text] = 1 / (1 + math.exp(-max(-60, min(60, z))))
        texts[r.doc_id, round(by_text[r.doc_id, r.text], 9)] += 2
    assert collections.Counter((r.doc_id, round(r.score, 9)) for r in rows) == texts and any(r.predicted for r in rows)


def test_several_passages_count_together():
    scanner = toxicity.Scanner(toxicity.Model({}, gap=-0.1, rate=1.0, size=0.1))
    one, three = scanner.evidence(100, [6.0]), scanner.evidence(100, [6.0, 6.0, 6.0])
    assert one == pytest.approx(6 - np.log(10)) and three > one and scanner.evidence(100, [6.0, 1.0]) == one and scanner.evidence(0, []) == pytest.approx(-np.log(0.1))


def test_toxicity_held_out(spark):
    docs = documents(spark, LARGER).select("doc_id", "text")
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    out = toxicity.score(docs, toxicity.train(docs, labels))
    assert out.count() == docs.count()
    rows = out.join(labels, "doc_id").filter("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    hit = [r.predicted for r in rows if r.toxic]
    miss = [r.predicted for r in rows if not r.toxic]
    assert sum(hit) / len(hit) > 0.85 and sum(miss) / len(miss) < 0.01
    assert any(r.passages for r in rows if r.predicted)


def test_toxicity_without_labels(spark):
    docs = awkward(spark)
    for labels in (spark.createDataFrame([], "doc_id bigint, toxic int"), spark.createDataFrame([(1, 1), (None, 0), (2, None), (3, 7)], "doc_id bigint, toxic int")):
        rows = toxicity.score(docs, toxicity.train(docs, labels)).collect()
        assert len(rows) == docs.count() and not any(r.predicted for r in rows)
    assert toxicity.score(empty(spark), toxicity.train(empty(spark), spark.createDataFrame([], "doc_id bigint, toxic int"))).count() == 0


def test_langid_held_out(spark):
    docs = documents(spark, LARGER)
    model = langid.train(docs)
    rows = langid.identify(docs.select("doc_id", "text"), model).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows) and len(rows) > 2000
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.99
    kept = [r for r in rows if not r.rejected]
    assert sum(r.lang_pred == r.lang for r in kept) / len(kept) > 0.99


def test_langid_by_brute_force(spark):
    """Every score from the trained model, subword by subword in plain Python."""
    import collections
    import math
    import unicodedata

    docs = awkward(spark).select("doc_id", "text", "lang").unionByName(documents(spark).select("doc_id", "text", "lang").limit(120)).filter("text IS NULL OR length(text) < 3000")
    model = langid.train(documents(spark))
    is_letter = lambda c: unicodedata.category(c)[0] == "L"

    def bucket(gram):
        h = len(gram)
        for c, m in zip(gram, langid.MULTIPLIERS, strict=False):
            h = ((h ^ (ord(c) if is_letter(c) else 0)) * m) & 0xFFFFFFFF
            h ^= h >> 15
        return h >> (32 - langid.BITS)

    def answer(text):
        if not any(is_letter(c) for c in text or ""):
            return "und", 0.0
        t = f"\n{text.lower()}\n"
        grams = []
        for n in langid.LENGTHS:
            for i in range(len(t) - n + 1):
                g = t[i : i + n]
                if all(map(is_letter, g[1:-1])) if n > 2 else any(map(is_letter, g)):
                    grams.append(bucket(g))
        z = [b / model.temperature for b in model.bias]
        for k in range(len(z)):
            z[k] += sum(float(model.logits[g, k]) for g in grams) / max(len(grams), 1) / model.temperature
        e = [math.exp(x - max(z)) for x in z]
        return model.langs[e.index(max(e))], round(max(e) / sum(e), 6)

    rows = langid.identify(docs, model).collect()
    want = collections.Counter((r.doc_id, *answer(r.text)) for r in docs.collect())
    assert collections.Counter((r.doc_id, r.lang_pred, round(r.score, 6)) for r in rows) == want


def test_langid_awkward(spark):
    docs = awkward(spark)
    rows = langid.identify(docs, langid.train(docs)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert 0 <= r.score <= 1
    und = langid.identify(spark.createDataFrame([(1, None), (2, "12 ,.-"), (3, ""), (4, "日本 x")], "doc_id bigint, text string"), langid.train(docs)).orderBy("doc_id").collect()
    assert [r.lang_pred == "und" for r in und] == [True, True, True, False]
    assert langid.train(empty(spark)) is None and langid.identify(docs, None).filter(F.col("lang_pred") != "und").count() == 0


def test_subwords_do_not_depend_on_slices():
    text = "Hello, wörld! " * 50
    whole = np.concatenate([b for _, b in langid.subwords([text])])
    two = [(r, b) for r, b in langid.subwords([text, "x"])]
    first = np.concatenate([b[r == 0] for r, b in two])
    assert sorted(whole) == sorted(first)
