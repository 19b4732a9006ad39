"""Structured documents (JSON, YAML) as segments; parsing runs in Python workers, a batch at a time."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import ship

SCHEMA = "source_uri string, seq bigint, type string, label string, content string, location string, error string"


def parse(text: str, mime: str):
    if "json" in mime:
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)


def leaves(value, label: str | None = None) -> Iterator[tuple[str, object]]:
    """(label, value) in order: objects and then what is in them, and scalars; lists only number what is in them. A lone scalar is ``root``."""
    stack = [(label, value)]
    while stack:
        name, v = stack.pop()
        if isinstance(v, dict):
            if name is not None:
                yield name, v
            stack.extend((k if name is None else f"{name}.{k}", x) for k, x in reversed(list(v.items())))
        elif isinstance(v, list):
            stack.extend((f"{name or ''}[{i}]", x) for i, x in reversed(list(enumerate(v))))
        else:
            yield ("root" if name is None else name), v


def as_text(value) -> str | None:
    """Strings as they are, anything else as JSON; null stays null."""
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False, default=str)


def structure(docs: DataFrame) -> DataFrame:
    """Segments of ``docs`` (source_uri, content, mime_type); what cannot be parsed gives one row with ``error`` instead of failing the job."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            out = []
            for uri, content, mime in zip(*(batch.column(c).to_pylist() for c in ("source_uri", "content", "mime_type")), strict=True):
                try:
                    out += [(uri, i, "structural", k, as_text(v), k, None) for i, (k, v) in enumerate(leaves(parse(content or "null", mime or "")))]
                except Exception as e:  # any parser error becomes a diagnostic of that document
                    out.append((uri, 0, None, None, None, None, f"{type(e).__name__}: {e}"[:500]))
            columns = list(zip(*out, strict=True)) if out else [[] for _ in names]
            kinds = [pa.string(), pa.int64(), *[pa.string()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.select("source_uri", "content", "mime_type").mapInArrow(run, SCHEMA)


def structure_native(docs: DataFrame) -> DataFrame:
    """Top-level keys of JSON objects, without Python: for wide tables of flat objects."""
    keys = F.json_object_keys("content")
    df = docs.select("source_uri", "content", F.posexplode(keys).alias("seq", "label"))
    value = F.get_json_object(F.col("content"), F.concat(F.lit("$['"), F.col("label"), F.lit("']")))
    return df.select("source_uri", F.col("seq").cast("long").alias("seq"), F.lit("structural").alias("type"), "label", value.alias("content"), F.col("label").alias("location"))
