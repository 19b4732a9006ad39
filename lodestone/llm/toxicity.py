"""Toxicity: maximum-scoring segments over token log-odds with a Dirichlet prior, calibrated by extreme-value statistics."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.bpe import Memo
from lodestone.llm.words import let, slices, table, text_or_empty, word_array
from lodestone.session import cut, ship

#: Labelled rows of each class that are learned from, about; more are sampled by a hash of their id.
TRAIN_ROWS = 6000
#: A token is a word or one of its prefixes of these lengths: compounds share their first part.
PREFIXES = (4, 5, 6, 7, 8)
#: A word, as everywhere here; of lower-cased text.
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: The prior's mass as a share of all counts, the least z of a scoring token, and the most tokens of a model.
PRIOR, LEAST_Z, MAX_TOKENS = 0.03, 2.3, 50_000
#: Share of the sample that tokens are counted in; the rest calibrates.
COUNTED = 0.6
#: Log-odds of one token are cut here, so that no single word makes a passage.
MOST = 6.0
#: A passage is significant if so many or fewer as good ones are expected by chance in a clean text of this length.
E_VALUE = 0.01


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % 5 == 0


@dataclass
class Model:
    """``scores`` of tokens, ``gap`` of any other word (negative); ``rate`` and ``size`` of the extreme-value law; the logistic's two numbers."""

    scores: dict
    gap: float = -0.05
    rate: float = 1.0
    size: float = 1.0
    slope: float = 1.0
    shift: float = 0.0


def word_score(model: Model, word: str) -> float:
    """The largest score of the word (of words()) and its prefixes that are in the model, else the gap's."""
    found = [s for k in PREFIXES if len(word) >= k and (s := model.scores.get(word[:k])) is not None]
    if (s := model.scores.get(word)) is not None:
        found.append(s)
    return max(found) if found else model.gap


def words(text: str) -> list[str]:
    """The tokenizer of training and scoring alike: lower-cased words between ASCII white space."""
    return WORDS.findall(text.lower())


def segments(scores: np.ndarray, gap: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) by Ruzzo and Tompa, in linear time; only positive places are walked.

    Each candidate knows the last one before it whose left sum is smaller, so that a search skips what an earlier search has passed.
    """
    at = np.flatnonzero(scores > 0)
    stack: list[tuple[int, int, float, float, int]] = []  # first, last, sum before the segment, sum up to its end, candidate with a smaller left sum
    total, seen = 0.0, 0
    for i, s in zip(at.tolist(), scores[at].tolist(), strict=True):
        total += gap * (i - seen)
        seen = i + 1
        first, left, right = i, total, total + s
        total = right
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                break
            first, left, before = stack[j][0], stack[j][2], stack[j][4]
            del stack[j:]
            j = before
        stack.append((first, i, left, right, j))
    return [(a, b, r - l) for a, b, l, r, _ in stack]


class Scanner:
    def __init__(self, model: Model):
        self.model = model
        self.memo = Memo({}, lambda w: word_score(model, w))

    def scan(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        found = words(text)
        scores = np.fromiter(map(self.memo.__getitem__, found), np.float64, len(found))
        return len(found), segments(scores, self.model.gap)

    def evidence(self, n: int, scores: list[float]) -> float:
        """Minus the logarithm of the chance that a clean text of ``n`` words has passages as good as these.

        Normalised scores are rate * score - ln(size * n). The best one alone follows a Gumbel law. The sum t of the r
        best ones reaches t with a chance of about e^-t t^(r-1) / (r! (r-1)!) (Karlin and Altschul, 1993). The least chance
        over all r counts, and each further passage costs a factor of 2 for having been looked at.
        """
        base = np.log(self.model.size * max(n, 1))
        x = np.sort(self.model.rate * np.array(scores or [0.0]) - base)[::-1]
        x = np.concatenate([x[:1], x[1:][x[1:] > 0]])
        if len(x) == 1:
            return float(x[0])
        r = np.arange(1, len(x) + 1)
        t = np.cumsum(x)
        log_factorial = np.cumsum(np.log(r))
        return float((t - (r - 1) * np.log(np.maximum(t, 1)) + 2 * log_factorial - np.log(r) - (r - 1) * np.log(2)).max())

    def chance(self, n: int, scores: list[float]) -> float:
        z = self.model.slope * self.evidence(n, scores) + self.model.shift
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def _token_counts(docs: DataFrame) -> DataFrame:
    """(token, toxic, clean): documents of each class with the token; texts are counted word by word, words then spread to prefixes."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [sorted(set(words(t or ""))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.list_(pa.string()))], ["toxic", "words"])

    spread = docs.select("toxic", "text").mapInArrow(run, "toxic int, words array<string>").select("toxic", F.explode("words").alias("word"))
    per_word = spread.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))
    tokens = F.array_distinct(F.array_append(F.filter(F.array(*[F.when(F.length("word") > k, F.left("word", F.lit(k))) for k in PREFIXES]), lambda x: x.isNotNull()), F.col("word")))
    return per_word.select(F.explode(tokens).alias("token"), "toxic", "clean").groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _log_odds(counts: DataFrame) -> DataFrame:
    """(token, odds, z, toxic, clean): log-odds ratio of the classes with an informative Dirichlet prior, over its deviation."""
    total = counts.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("nt"), F.coalesce(F.sum("clean"), F.lit(0)).alias("nc")).first()
    nt, nc = float(total.nt or 0), float(total.nc or 0)
    mass = max(PRIOR * (nt + nc), 1.0)
    prior = (F.col("toxic") + F.col("clean")) / F.lit(max(nt + nc, 1.0)) * F.lit(mass)
    t, c = F.col("toxic") + prior, F.col("clean") + prior
    odds = F.ln(t / (F.lit(nt + mass) - t)) - F.ln(c / (F.lit(nc + mass) - c))
    return counts.withColumn("odds", odds).withColumn("z", F.col("odds") / F.sqrt(1 / t + 1 / c))


def sample_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic, weight, part): at most about TRAIN_ROWS rows of each class, none held out, one of each cluster of near copies.

    Rows that share their least hash of three words are taken for copies: a text that stands a thousand times would
    otherwise lend its weight to all its words. ``weight`` is the inverse of the class's share; ``part`` (0 to 1) divides counting from calibration.
    """
    labels = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = {r.toxic: r.n for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    u = F.pmod(F.xxhash64(F.lit(8), "doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    share = F.lit(0.0)
    for k in (0, 1):
        share = F.when(F.col("toxic") == k, F.lit(min(1.0, TRAIN_ROWS / max(n.get(k, 0), 1)))).otherwise(share)
    drawn = labels.filter(u < share).withColumn("weight", 1 / share)  # at most about 2 * TRAIN_ROWS ids
    mine = docs.select(F.col("doc_id").alias("__id"), "text").join(F.broadcast(drawn), F.col("__id") == F.col("doc_id")).select("doc_id", "text", "toxic", "weight")
    least = let(word_array(F.lower(text_or_empty())), lambda w: F.when(F.size(w) >= 3, F.array_min(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))).otherwise(F.xxhash64(F.array_join(w, " "))))
    one = mine.withColumn("__k", least).groupBy("__k").agg(F.min_by(F.struct("text", "toxic", "weight"), F.struct("doc_id", "text")).alias("r"))
    return cut(one.select("r.text", "r.toxic", "r.weight", (F.pmod(F.xxhash64(F.lit(9), "__k"), F.lit(1 << 40)) / F.lit(float(1 << 40))).alias("part")))


def _scan_rows(docs: DataFrame, model: Model) -> DataFrame:
    """(toxic, weight, n, best, evidence, hits) of labelled rows: words, best segment, evidence of all, words within segments."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["n", "best", "evidence", "hits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value)
        for batch in slices(batches):
            rows = []
            for n, found in map(scanner.scan, (t or "" for t in batch.column("text").to_pylist())):
                scores = [s for _, _, s in found]
                rows.append((n, max(scores, default=0.0), scanner.evidence(n, scores), sum(b - a + 1 for a, b, _ in found)))
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            kinds = (pa.int64(), pa.float64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("weight"), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], ["toxic", "weight", *names])

    return docs.select("text", "toxic", "weight").mapInArrow(run, "toxic int, weight double, n bigint, best double, evidence double, hits bigint")


def _rate(pairs: list[tuple[float, float]], gap: float) -> float:
    """The positive root x of sum p * exp(x * score) = 1 over the scores of a clean text's words (Karlin and Altschul)."""
    p = np.array([c for _, c in pairs] or [1e-9])
    s = np.array([v for v, _ in pairs] or [1.0])
    rest = max(1e-9, 1 - p.sum())
    f = lambda x: float((p * np.exp(x * s)).sum() + rest * np.exp(x * gap) - 1)
    low, high = 1e-6, 1e-6
    while f(high) < 0 and high < 50:
        high = high * 2 + 1e-3
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return max(low, 1e-3)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from a bounded sample of labelled rows; without a token that tells the classes apart it calls nothing toxic.

    The rows that are not counted calibrate: clean ones give the extreme-value law its size, then all of them the logistic.
    """
    sample = sample_of(docs, labels)
    counts = cut(_token_counts(sample.filter(F.col("part") < COUNTED)))
    odds = cut(_log_odds(counts))
    top = odds.filter((F.col("z") >= LEAST_Z) & (F.col("odds") > 1)).orderBy(F.desc("z"), "token").limit(MAX_TOKENS).collect()
    model = Model({r.token: min(MOST, float(r.odds)) for r in top})
    if not top:
        return Model({}, slope=0.0, shift=-20.0)
    n_words, hits = {0: 0, 1: 0}, {0: 0, 1: 0}
    seen = _scan_rows(sample, Model(model.scores, gap=-1e9)).groupBy("toxic").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).collect()
    for r in seen:  # with so large a gap, a segment is a run of scoring words
        n_words[r.toxic], hits[r.toxic] = r.n or 0, r.hits or 0
    share = {k: (hits[k] + 0.5) / (n_words[k] + 1.0) for k in n_words}
    model.gap = float(np.clip(np.log(1 - min(share[1], 0.9)) - np.log(1 - share[0]), -0.5, -0.02))
    mean = float(np.mean(list(model.scores.values())))
    model.rate = _rate([(mean, min(share[0], 0.5 * -model.gap / (mean - model.gap)))], model.gap)
    rest = sample.filter(F.col("part") >= COUNTED)
    clean = [(r.n, r.best) for r in _scan_rows(rest.filter("toxic = 0"), model).select("n", "best").collect()]
    model.size = float(np.clip(len(clean) / max(sum(n * np.exp(-model.rate * b) for n, b in clean), 1e-9), 1e-9, 1e3)) if clean else 1.0
    rows = sorted((r.toxic, r.evidence, r.weight) for r in _scan_rows(rest, model).collect())
    x, y = np.array([e for _, e, _ in rows]), np.array([t for t, *_ in rows], float)
    if len(set(y.tolist())) == 2:
        model.slope, model.shift = _logistic(x, y, np.array([w for *_, w in rows]))
    else:
        model.slope, model.shift = 1.0, -4.0
    return model


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Newton's method on standardised x."""
    mean, dev = x.mean(), x.std() or 1.0
    z = np.stack([(x - mean) / dev, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (weight * (p - y)) + ridge * w
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    slope = max(w[0] / dev, 1e-6)
    return float(slope), float(w[1] - w[0] * mean / dev)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted, passages) of every row; whole texts are scanned.

    ``passages``: every significant segment (first and last word, score, expected number by chance). The score is the
    calibrated chance of the label, from the evidence of all passages together. Null and empty texts have no passage and the
    score of a text without evidence. A row depends on its text alone: repeated rows score alike, and rows without doc_id are not held out.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    passage = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value)
        m = scanner.model
        for batch in slices(batches):
            chances, passages = [], []
            for t in batch.column("__text").to_pylist():
                n, found = scanner.scan(t)
                chances.append(scanner.chance(n, [s for _, _, s in found]))
                expected = [(a, b, s, float(m.size * max(n, 1) * np.exp(-m.rate * s))) for a, b, s in found]
                passages.append([{"first": a, "last": b, "score": s, "e_value": e} for a, b, s, e in expected if e <= E_VALUE])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(chances, pa.float64()), pa.array([int(c >= 0.5) for c in chances], pa.int32()), pa.array(passages, passage)], ["doc_id", "held_out", "score", "predicted", "passages"])

    slim = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), text_or_empty().alias("__text"))
    return slim.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, passages array<struct<first:int,last:int,score:double,e_value:double>>")


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of every document, learned from the labelled rows that are not held out; see score() for nulls, empty texts and repeats."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return score(docs, train(docs, table(spark, folder, "labels").select("doc_id", "toxic")))
