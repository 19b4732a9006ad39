"""Small documents that hold the awkward cases, as Spark rows."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, key string, digest string, fp string, shard int, component_id string"
FOLDER = "/root/testdata/sf0.01"


def awkward(spark, seed=1):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and extra columns whose names clash."""
    rng = random.Random(seed)
    words = ["alpha", "beta", "Gamma", "the", "of", "delta,", "ço", "naïve", "日本", "x"]
    body = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = " ".join(f"w{i} the" for i in range(15_000))
    base = body(80)
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, base.replace(" ", "\n"), "en", None), (4, None, None, "b"), (5, "", "fr", "b"), (6, " \t\n", "de", None),
        (7, long, "en", "c"), (None, body(60), "en", "c"), (None, body(60), None, None), (8, "one", "en", "d"), (9, "one two", "en", "d"), (10, "One tWo", None, "d"),
        (11, "A" * 70_000, "en", "a"), (12, "<|endoftext|> hello <|endoftext|>", "en", "a"), (13, "é  x y \U0001f600 'S don't \x1c 12²", "fr", "a"), (14, base + " more", "en", "a"),
        (15, "\n".join(["same line here"] * 40), "en", "e"), (16, body(200), "es", "e"), (16, body(70), "es", "e"), (-5, body(51), "en", "f"), (20, "   \n" * 30_000 + "end", "en", "f"),
    ]
    full = [(i, t, lang, s, len(t) if t is not None else None, 1, "k", "d", "f", 3, "c") for i, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, folder=FOLDER):
    return spark.read.parquet(f"{folder}/documents.parquet")
