"""Segmenters against plain Python over random texts, and their time on a long text."""

import json
import random
import re
import time

import pytest

from lodestone.operators import segments as S

PIECES = ["# A title", "## B ##", "####### no", "#x", "text here.", "more! and", "===", "---", "- - -", "| a | b |", "|---|---|", "a|b", "", "", "  ", "\t", "```py", "```", "x = 1", "-", "=", " --- ", "é. Ü? z"]


def texts(n=150, seed=7):
    rng = random.Random(seed)
    return ["\n".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))) for _ in range(n)] + ["", "\nabc", "\n\nabc", "---", "===\n===\n===\n===", "a\n---\n---\n---", "a|b", "x\n\n\n\ny\n"]


def brute_headings(t):
    out = []
    for n, line in enumerate(t.split("\n"), 1):
        if m := re.fullmatch(r"(#{1,6})\s+(.+?)(?:\s+#*)?", line):
            out.append((f"h{len(m[1])}", m[2].strip(), f"line {n}"))
    lines, i = t.splitlines(), 0
    while i + 1 < len(lines):
        mark = lines[i + 1].strip()
        if mark and (set(mark) == {"="} or set(mark) == {"-"}):
            out.append(("h1" if mark[0] == "=" else "h2", lines[i].strip(), f"line {i + 1}"))
            i += 1
        i += 1
    return out


def brute_paragraphs(t):
    out, at = [], 0
    for gap in [*re.finditer(r"\n\s*\n", t), None]:
        block, start = t[at : gap.start() if gap else len(t)], at
        at = gap.end() if gap else at
        own = block.strip()
        lines = own.splitlines()
        if own and not own.startswith(("#", "```")) and not own.endswith("```") and not (all("|" in x for x in lines) and any("-" in x for x in lines)):
            out.append((None, own, f"line {t[:start].count(chr(10)) + 1}"))
    return out


def brute_code(t):
    return [(m[1], m[2].strip("\n"), f"code block {i} (line {t[: m.start()].count(chr(10)) + 1})") for i, m in enumerate(re.finditer(r"```[ \t]*(\w+)?[ \t]*\r?\n(.*?)```", t, re.DOTALL), 1)]


def brute_tables(t):
    out, lines, i = [], t.splitlines(), 0
    while i < len(lines):
        j = i
        while j < len(lines) and "|" in lines[j]:
            j += 1
        rows = []
        for line in lines[i:j]:
            if not (set(line) <= set("-:| \t") and "-" in line):
                cells = [c.strip() for c in line.split("|")]
                cells = cells[1:] if line.startswith("|") and cells[0] == "" else cells
                rows.append(cells[:-1] if line.endswith("|") and cells and cells[-1] == "" else cells)
        if rows := [r for r in rows if r]:
            out.append(("table", rows, f"lines {i + 1}-{j}"))
        i = max(j, i + 1)
    return out


def brute_sentences(t):
    out, line = [], 1
    for s in re.split(r"(?<=[.!?])\s+", t.strip()):
        if s.strip():
            out.append((None, s.strip(), f"line {line}"))
            line += s.strip().count("\n") + 1
    return out


@pytest.mark.parametrize("made,brute", [(S.headings, brute_headings), (S.paragraphs, brute_paragraphs), (S.code_blocks, brute_code), (S.tables, brute_tables), (S.sentences, brute_sentences)])
def test_random_texts(spark, made, brute):
    given = texts()
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(given)], "source_uri string, content string")
    got = {}
    for r in made(docs).orderBy("seq").collect():
        got.setdefault(int(r.source_uri), []).append((r.label, json.loads(r.content) if r.type == "table" else r.content, r.location))
    for i, t in enumerate(given):
        assert got.get(i, []) == brute(t), repr(t)


@pytest.mark.parametrize("made", [S.headings, S.paragraphs, S.code_blocks, S.tables, S.sentences])
def test_long_text(spark, made):
    body = "\n\n".join(f"Part {i}. One | two.\n---\n```\nx\n```\nend" for i in range(20_000))
    docs = spark.createDataFrame([("u", body)], "source_uri string, content string")
    began = time.time()
    assert made(docs).count() >= 20_000
    assert time.time() - began < 30
