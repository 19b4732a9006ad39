"""Language ID: averaged hashed subword embeddings with a linear softmax, trained in numpy, with calibrated rejection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.words import slices, table, text_or_empty
from lodestone.session import cut, ship

#: Subwords are runs of so many characters within a word and its two borders, hashed to 2 ** BITS rows of DIM numbers.
LENGTHS, BITS, DIM = (2, 3, 4), 14, 16
#: Rows that are learned from, at most about: sampled by a hash of their id, in equal parts of each language.
TRAIN_ROWS = 4000
#: Languages that can be told apart: one column of the model and one branch of the sampling expression each. More raise an error.
MAX_LANGS = 1000
EPOCHS, RATE, BATCH = 12, 0.5, 32
#: Share of the sample that only calibrates, and the accuracy that answers above the rejection threshold must reach on it.
CALIBRATED, ACCURACY = 0.25, 0.99
#: Characters that are turned to features at once.
SLICE = 1 << 20
MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % 4 == 2


@lru_cache(1)
def letter_table() -> np.ndarray:
    """For each code point, whether it is a letter (Unicode category L*)."""
    import unicodedata

    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)], bool)


def subwords(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of the text, bucket) of all subwords of the texts, lower-cased, a slice of characters at a time."""
    group, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(len(t), 1), SLICE):
            # a long text's slices overlap by a word's border at most; its cut words add a few odd subwords
            group.append((i, t[at : at + SLICE]))
            size += len(group[-1][1]) + 1
            if size >= SLICE:
                yield from _slice(group)
                group, size = [], 0
    if group:
        yield from _slice(group)


def _slice(group: list[tuple[int, str]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    lowered = [t.lower() for _, t in group]
    points = np.frombuffer(("\n" + "\n".join(lowered) + "\n").encode("utf-32-le"), np.uint32)
    letter = letter_table()[points]
    points = np.where(letter, points, np.uint32(0))
    row = np.repeat(np.array([i for i, _ in group], np.int64), [len(t) + 1 for t in lowered])
    row = np.concatenate([row, row[-1:]])
    for n in LENGTHS:
        m = len(points) - n + 1
        if m < 1:
            continue
        inner = letter[1 : 1 + m].copy() if n > 2 else (letter[:m] | letter[1 : 1 + m])
        for k in range(2, n - 1):
            inner &= letter[k : k + m]
        at = np.flatnonzero(inner)
        h = np.full(len(at), n, np.uint32)
        for k in range(n):
            h = (h ^ points[at + k]) * np.uint32(MULTIPLIERS[k])
            h ^= h >> np.uint32(15)
        yield row[at], (h >> np.uint32(32 - BITS)).astype(np.int32)


@dataclass
class Model:
    """``logits``: what each bucket adds, the embeddings times the output layer; langs in order; calibration."""

    langs: list
    logits: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0


def scores(model: Model, texts: list[str]) -> np.ndarray:
    """Softmax of the mean of the subwords' logits, one row per text; rows without subwords are even."""
    total, count = np.zeros((len(texts), len(model.langs))), np.zeros(len(texts))
    for row, bucket in subwords(texts):
        if not len(row):
            continue
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        np.add.at(total, row[starts], np.add.reduceat(model.logits[bucket], starts, axis=0, dtype=np.float64))
        np.add.at(count, row[starts], np.diff(np.r_[starts, len(row)]))
    z = (total / np.maximum(count, 1)[:, None] + model.bias) / model.temperature
    z -= z.max(axis=1, keepdims=True)
    e = np.exp(z)
    return e / e.sum(axis=1, keepdims=True)


def sample_of(docs: DataFrame) -> tuple[list[str], DataFrame]:
    """Languages, and (lang, buckets, counts, part) of at most about TRAIN_ROWS rows, none held out, in equal parts of each language.

    More than MAX_LANGS languages raise, so that none is left out.
    """
    ship(docs.sparkSession)
    rows = docs.filter("lang IS NOT NULL AND text IS NOT NULL").filter(~held_out(F.col("doc_id")))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGS + 1).collect()}
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs = sorted(sizes)
    u = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    share = F.lit(0.0)
    for lang in langs:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, TRAIN_ROWS / len(langs) / sizes[lang]))).otherwise(share)
    drawn = rows.filter(u < share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for lang, text, part in zip(*(batch.column(c).to_pylist() for c in ("lang", "text", "part")), strict=True):
                counts = np.zeros(1 << BITS, np.int64)
                for _, bucket in subwords([text]):
                    counts += np.bincount(bucket, minlength=1 << BITS)
                at = np.flatnonzero(counts)
                weight = (counts[at] / max(counts.sum(), 1)).astype(np.float32)
                yield pa.RecordBatch.from_pydict({"lang": [lang], "bucket": [at.astype(np.uint16).tobytes()], "weight": [weight.tobytes()], "part": [part]})

    part = F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return langs, drawn.select("lang", "text", part.alias("part")).mapInArrow(run, "lang string, bucket binary, weight binary, part double")


def train(docs: DataFrame, seed: int = 9) -> Model | None:
    """Stochastic gradient descent over embeddings and output layer; None if no row has a language.

    At most TRAIN_ROWS rows' bucket shares reach the driver, each of at most 2 ** BITS numbers.
    """
    langs, features = sample_of(docs)
    if not langs:
        return None
    number = {lang: i for i, lang in enumerate(langs)}
    rows = [(number[r.lang], np.frombuffer(r.bucket, np.uint16).astype(np.int32), np.frombuffer(r.weight, np.float32), r.part) for r in cut(features).toLocalIterator()]
    rows = [r for r in sorted(rows, key=lambda r: r[3]) if len(r[1])]
    fit, held = [r for r in rows if r[3] >= CALIBRATED], [r for r in rows if r[3] < CALIBRATED]
    fit = fit or rows
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM))
    out, bias = np.zeros((DIM, len(langs))), np.zeros(len(langs))
    steps, done = max(1, EPOCHS * len(fit)), 0
    for _ in range(EPOCHS):
        for at in np.array_split(rng.permutation(len(fit)), max(1, len(fit) // BATCH)):
            rate = RATE * (1 - done / steps)
            done += len(at)
            hidden = np.array([fit[i][2] @ emb[fit[i][1]] for i in at])
            z = hidden @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(at)), [fit[i][0] for i in at]] -= 1
            back = p @ out.T
            out -= rate * hidden.T @ p
            bias -= rate * p.mean(axis=0)
            for i, g in zip(at, back, strict=True):
                emb[fit[i][1]] -= (8 * rate) * fit[i][2][:, None] * g[None, :]
    model = Model(langs, (emb @ out).astype(np.float32), bias)
    _calibrate(model, held or fit)
    return model


def _calibrate(model: Model, rows: list) -> None:
    """The temperature of least loss, then the least threshold above which answers are accurate."""
    if not rows:
        return
    z = np.array([(w[:, None] * model.logits[b]).sum(axis=0) + model.bias for _, b, w, _ in rows], np.float64)
    y = np.array([r[0] for r in rows])

    def soft(t: float) -> np.ndarray:
        e = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return e / e.sum(axis=1, keepdims=True)

    loss = lambda t: -np.log(np.maximum(soft(t)[np.arange(len(y)), y], 1e-12)).mean()
    model.temperature = float(min(np.geomspace(0.05, 20, 121), key=loss))
    p = soft(model.temperature)
    top, right = p.max(axis=1), p.argmax(axis=1) == y
    order = np.argsort(-top)
    good = np.cumsum(right[order]) / np.arange(1, len(y) + 1) >= ACCURACY
    model.threshold = float(top[order][np.flatnonzero(good).max()]) if good.any() else 1.0


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every row, from the whole text.

    ``lang_pred`` is ``und`` with score 0 for null texts, texts without a letter, and where there was nothing to learn from.
    ``rejected`` marks answers below the calibrated threshold; they keep their best language.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches):
            texts = batch.column("__text").to_pylist()
            has = np.array([any(map(str.isalpha, t)) for t in texts], bool)
            p = scores(m, texts) if m else np.zeros((len(texts), 1))
            top = np.where(has, p.max(axis=1), 0.0) if len(texts) else np.zeros(0)
            langs = [m.langs[k] if h and m else "und" for k, h in zip(p.argmax(axis=1), has, strict=True)]
            rejected = [bool(h and m and s < m.threshold) or lang == "und" for h, s, lang in zip(has, top, langs, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(top, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    slim = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), text_or_empty().alias("__text"))
    return slim.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def op9_langid(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    return identify(docs, train(docs))
