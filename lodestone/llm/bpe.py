"""Byte-level BPE: merging by rank, token counts by the whole-token shortcut, encoding in overlapping chunks."""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import pairwise, repeat
from operator import add

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.words import slices, table, text_or_empty
from lodestone.session import ship

#: Pieces longer than this are merged with a heap.
SHORT = 48
NO_RANK = 1 << 62
#: Distinct pieces in each of the two generations that a worker remembers.
REMEMBERED = 150_000


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def merge(parts: list, ranks: dict, joined: bool) -> list:
    """``parts`` after merging, again and again, the leftmost adjacent pair of the least rank.

    ``ranks`` has the rank of joining a and b under a + b if ``joined``, else under (a, b). Short inputs keep the ranks of
    their pairs in a list, long ones a linked list with a heap of pairs: O(n log n).
    """
    rank = ranks.get
    if len(parts) > SHORT:
        return _merge_long(parts, (lambda a, b: rank(a + b)) if joined else (lambda a, b: rank((a, b))))
    row = list(map(rank, map(add, parts, parts[1:]) if joined else pairwise(parts), repeat(NO_RANK)))
    while row:
        least = min(row)
        if least == NO_RANK:
            break
        i = row.index(least)
        new = parts[i] + parts[i + 1]
        parts[i : i + 2] = (new,)
        del row[i]
        if i < len(row):
            row[i] = rank(new + parts[i + 1] if joined else (new, parts[i + 1]), NO_RANK)
        if i:
            row[i - 1] = rank(parts[i - 1] + new if joined else (parts[i - 1], new), NO_RANK)
    return parts


#: The 256 byte strings of length 1.
SINGLE = [bytes([b]) for b in range(256)]


def merged(raw: bytes, ranks: dict, joined: bool) -> list[bytes]:
    return merge(list(map(SINGLE.__getitem__, raw)), ranks, joined)


def _merge_long(parts: list, rank: Callable) -> list:
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank(parts[i], parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if parts[i] is not left or j >= n or parts[j] is not right:
            continue
        parts[i], parts[j] = left + right, None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := rank(parts[i], parts[after[i]])) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[after[i]]))
        if before[i] >= 0 and (r := rank(parts[before[i]], parts[i])) is not None:
            heapq.heappush(heap, (r, before[i], parts[before[i]], parts[i]))
    return [p for p in parts if p is not None]


class Memo(dict):
    """piece -> value; misses are computed and remembered in two generations of at most ``limit`` pieces each, so that frequent ones stay."""

    def __init__(self, known: dict, compute: Callable, limit: int = REMEMBERED):
        super().__init__(known)
        self.known, self.compute, self.limit, self.old = known, compute, limit + len(known), {}

    def __missing__(self, piece):
        value = self.old.pop(piece, None)
        if value is None:
            value = self.compute(piece)
        if len(piece) <= 256:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
                self.update(self.known)
            self[piece] = value
        return value


# ---- token counts -------------------------------------------------------------------------------------------------


@lru_cache(1)
def byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


def read_merges(path: str) -> dict:
    """Merges (pairs of byte strings, in order), the vocabulary and the special strings of a tokenizer file."""
    spec = json.loads(open(path, encoding="utf-8").read())
    back = {c: b for b, c in byte_alphabet().items()}
    raw = lambda s: bytes(back[c] for c in s)
    special = {t["content"] for t in spec["added_tokens"]}
    return {"merges": [(raw(a), raw(b)) for a, b in spec["model"]["merges"]], "vocabulary": [raw(t) for t in spec["model"]["vocab"] if t not in special], "special": sorted(special, key=lambda s: (-len(s), s))}


def prove_whole(merges: list, vocabulary: list[bytes]) -> dict[str, int]:
    """Vocabulary strings that, as a piece of their own, merge to one token; each with the count 1.

    Only such strings may be counted without merging: a vocabulary entry can be out of reach of the merges.
    """
    ranks = {pair: i for i, pair in enumerate(merges)}
    whole = {}
    for raw in vocabulary:
        try:
            piece = raw.decode("utf-8")
        except UnicodeDecodeError:
            continue  # no piece of a text
        if len(merged(raw, ranks, False)) == 1:
            whole[piece] = 1
    return whole


class TokenCounter:
    """Counts the tokens of a text: special strings are one each, whole pieces one each, the rest is merged."""

    def __init__(self, spec: dict):
        ranks = {pair: i for i, pair in enumerate(spec["merges"])}

        self.pieces = regex.compile(spec["pattern"]).findall
        self.special = regex.compile("|".join(map(regex.escape, spec["special"]))) if spec["special"] else None
        self.memo = Memo(spec["whole"], lambda piece: len(merged(piece.encode("utf-8"), ranks, False)))

    def __call__(self, text: str) -> int:
        parts = self.special.split(text) if self.special else [text]
        count = self.memo.__getitem__
        return len(parts) - 1 + sum(sum(map(count, self.pieces(p))) for p in parts)


#: What a worker has built from a broadcast; kept over the tasks of a worker.
_BUILT: dict = {}


def _built(kind: type, broadcast):
    key = (kind.__name__, getattr(broadcast, "id", None) or broadcast.value["key"])
    if _BUILT.get("key") != key:
        _BUILT.clear()
        _BUILT.update(key=key, value=kind(broadcast.value))
    return _BUILT["value"]


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs``; a null text counts as empty: no bytes, no tokens.

    Special strings in a text are one token each, as the library has it by default. Each task streams its rows; the
    vocabulary, whose size is fixed, is the only thing that is broadcast.
    """
    ship(docs.sparkSession)
    spark = docs.sparkSession
    spec = read_merges(path)
    spec |= {"pattern": split_pattern(), "whole": prove_whole(spec["merges"], spec["vocabulary"]), "key": path}
    del spec["vocabulary"]
    shared = spark.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _built(TokenCounter, shared)
        for batch in slices(batches):
            counts = [counter(t) for t in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    slim = docs.select("doc_id", F.octet_length(text_or_empty(text)).cast("long").alias("n_bytes"), text_or_empty(text).alias("__text"))
    out = slim.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op3_token_count(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"))


# ---- encoding and decoding ----------------------------------------------------------------------------------------

#: Code points of a chunk, and of the part it shares with the next one.
CHUNK, OVERLAP = 65_536, 1_024


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Codec:
    """Ids are packed as little-endian unsigned 32-bit integers."""

    def __init__(self, spec: dict):
        ranks = spec["ranks"]
        self.token = {i: t for t, i in ranks.items()}
        packed = {t: i.to_bytes(4, "little") for t, i in ranks.items()}

        def encoded(piece: str) -> bytes:
            raw = piece.encode("utf-8")
            if raw in packed:
                return packed[raw]
            return b"".join([packed[t] for t in merged(raw, ranks, True)])

        self.pattern = regex.compile(spec["pattern"])
        self.memo = Memo({}, encoded)

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def encode_pieces(self, pieces: list[str]) -> bytes:
        return b"".join(map(self.memo.__getitem__, pieces))

    def encode(self, text: str) -> bytes:
        return self.encode_pieces(self.pieces(text))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, memoryview(ids).cast("I").tolist()))

    def bounds(self, text: str, last: bool) -> list[int]:
        """Ends of the pieces that more text behind could not change; all of them for the last chunk.

        A piece is settled by at most two characters behind its end, and, for the contractions, three behind its start.
        """
        n = len(text)
        return [m.end() for m in self.pattern.finditer(text) if last or (m.end() + 2 <= n and m.start() + 3 <= n)]


def chunks_of(text: str, size: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, str]]:
    """(start, chunk) of overlapping chunks; a text of up to size + overlap is one chunk."""
    starts = range(0, max(1, len(text) - overlap), size)
    return [(s, text[s : s + size + overlap]) for s in starts]


def stitch(chunks: list[tuple[int, str, list[int]]], codec: Codec) -> Iterator[list[str]]:
    """The pieces of a whole text, in order and in lists, from its chunks (start, text, settled bounds, all absolute).

    What the pieces are depends only on the text from a bound on. So from the first bound that the left chunk and
    the right one share, the right one's pieces are those of the whole text. Where they share none, as one piece
    covers the shared part, the text from the left one's last settled bound on is split anew.
    """
    at, (start, text, bounds) = 0, chunks[0]

    def upto(end: int) -> list[str]:
        cuts = [at, *(b for b in bounds if at < b <= end)]
        return [text[a - start : b - start] for a, b in zip(cuts, cuts[1:], strict=False)]

    for k, (s, right, ends) in enumerate(chunks[1:], 1):
        mine = {b for b in (at, *bounds) if b >= s}
        meet = next((b for b in (s, *ends) if b in mine), None)
        if meet is not None:
            yield upto(meet)
            at, start, text, bounds = meet, s, right, [b for b in ends if b > meet]
            continue
        end = bounds[-1] if bounds else at
        yield upto(end)
        text = text[end - start :] + right[start + len(text) - s :]
        at = start = end
        last = k == len(chunks) - 1
        bounds = [end + b for b in codec.bounds(text, last)] if ends or last else []  # a chunk within one piece only lengthens it
    yield upto(start + len(text))


def round_trip(docs: DataFrame, path: str, text: str = "text", size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids, decoded) of every row of ``docs``: packed ids of the whole text, and the bytes that they decode to.

    Texts of one chunk are encoded where they are read. Longer ones are cut into overlapping chunks that are dealt over
    all tasks and split into pieces there; then each text's chunks meet to be stitched, encoded and decoded. A null
    text counts as empty: no ids, no bytes. Rows that repeat a doc_id stay apart. Special strings are ordinary text.
    """
    ship(docs.sparkSession)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast({"ranks": read_ranks(path), "pattern": split_pattern(), "key": path})
    kind = docs.schema["doc_id"].dataType.simpleString()
    slim = docs.select("doc_id", text_or_empty(text).alias("__text"))
    names = ["doc_id", "ids", "decoded"]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _built(Codec, shared)
        for batch in slices(batches):
            ids = [codec.encode(t) for t in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array([codec.decode(i) for i in ids], pa.binary())], names)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for row in batch.to_pylist():
                parts = chunks_of(row["__text"], size, overlap)
                yield pa.RecordBatch.from_pylist([{"uid": row["uid"], "doc_id": row["doc_id"], "k": k, "n": len(parts), "start": s, "chunk": c} for k, (s, c) in enumerate(parts)], schema=chunk_schema)

    def split_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _built(Codec, shared)
        for batch in slices(batches):
            bounds = [[s + b for b in codec.bounds(c, k == n - 1)] for k, n, s, c in zip(*(batch.column(x).to_pylist() for x in ("k", "n", "start", "chunk")), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bounds, pa.list_(pa.int64()))], [*chunk_schema.names, "bounds"])

    def join_up(group: pa.Table) -> pa.Table:
        codec = _built(Codec, shared)
        rows = sorted(group.to_pylist(), key=lambda r: r["k"])
        ids = b"".join(codec.encode_pieces(p) for p in stitch([(r["start"], r["chunk"], r["bounds"]) for r in rows], codec))
        return pa.table([pa.array([rows[0]["doc_id"]], group.schema.field("doc_id").type), pa.array([ids], pa.binary()), pa.array([codec.decode(ids)], pa.binary())], names=names)

    schema = f"doc_id {kind}, ids binary, decoded binary"
    long = F.length("__text") > size + overlap
    short = slim.filter(~long).mapInArrow(whole, schema)
    chunk_type = f"uid bigint, doc_id {kind}, k int, n int, start bigint, chunk string"
    from pyspark.sql.pandas.types import to_arrow_schema

    probe = spark.createDataFrame([], chunk_type)
    chunk_schema = to_arrow_schema(probe.schema)
    pieces = slim.filter(long).withColumn("uid", F.monotonically_increasing_id()).mapInArrow(cut_up, chunk_type).repartition("uid", "k").mapInArrow(split_up, chunk_type + ", bounds array<bigint>")
    return short.unionByName(pieces.groupBy("uid").applyInArrow(join_up, schema))


def digests(encoded: DataFrame) -> DataFrame:
    """Counts and digests of what round_trip() returns."""
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_bpe_codec(spark: SparkSession, folder: str) -> DataFrame:
    return digests(round_trip(table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.tiktoken")))


def encode_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline stage: token ids of every row, as counts and digests."""
    return digests(round_trip(docs, tokenizer_path("byte_bpe_50k.tiktoken")))
