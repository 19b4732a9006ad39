"""Markdown as a tree of elements, and its segments. An own block and inline parser; it runs in Python workers.

Blocks: front matter, headings of both kinds, paragraphs, fenced and indented code, quotes, nested lists with tasks, tables, rules, HTML, footnotes.
Inline: code, links, images, autolinks and HTML are kept apart; emphasis and strikethrough leave their text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone import schemas
from lodestone.session import ship


@dataclass
class Element:
    type: str
    content: object = None
    level: int | None = None
    start: int | None = None
    end: int | None = None
    metadata: dict = field(default_factory=dict)
    children: list = field(default_factory=list)


# ---- blocks -----------------------------------------------------------------------------------------------------------

ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
FENCE = re.compile(r"( {0,3})(`{3,}|~{3,})[ \t]*([^`]*)$")
RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
ITEM = re.compile(r"( {0,3})([-*+]|\d{1,9}[.)])(?:([ \t]+)(.*)|$)")
SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
HTML = re.compile(r" {0,3}<(?:!--|[?!]|/?[A-Za-z][A-Za-z0-9-]*(?:[\s/>]|$))")
NOTE = re.compile(r" {0,3}\[\^([^\]\s]+)\]:[ \t]*(.*)$")
DELIMITER = re.compile(r"[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
DEPTH = 60


def _indent(line: str) -> int:
    return len(line.expandtabs(4)) - len(line.expandtabs(4).lstrip(" "))


def _dedent(line: str, n: int) -> str:
    line = line.expandtabs(4) if "\t" in line[:n] else line
    return line[min(n, len(line) - len(line.lstrip(" "))) :]


def cells(line: str) -> list[str]:
    line = line.strip()
    line = line[1:] if line.startswith("|") else line
    line = line[:-1] if line.endswith("|") and not line.endswith("\\|") else line
    return [c.replace("\\|", "|").strip() for c in re.split(r"(?<!\\)\|", line)]


def front_matter(lines: list[str]) -> tuple[Element | None, int]:
    """The element of a leading block between ``---`` lines, and where the rest begins."""
    if not lines or lines[0].rstrip() != "---":
        return None, 0
    for n in range(1, len(lines)):
        if lines[n].rstrip() in ("---", "..."):
            raw = "\n".join(lines[1:n])
            meta: dict = {"raw": raw}
            try:
                import yaml

                data = yaml.safe_load(raw)
                meta["data"] = data if isinstance(data, dict) else {"value": data}
            except Exception as e:  # whatever the YAML reader dislikes is kept as raw text
                meta["parse_error"] = str(e)[:300]
            return Element("metadata", raw, start=1, end=n + 1, metadata=meta), n + 1
    return None, 0


def blocks(lines: list[str], first: int, depth: int = 0) -> list[Element]:
    """Elements of ``lines``, the first of which is line ``first`` of the document."""
    out: list[Element] = []
    notes: list[Element] = []
    i, n = 0, len(lines)

    def at(k: int) -> int:
        return first + k

    while i < n:
        line = lines[i]
        if not line.strip():
            i += 1
            continue
        start = i
        if m := FENCE.match(line):
            mark, body = m[2], []
            i += 1
            while i < n and not re.match(rf" {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$", lines[i]):
                body.append(_dedent(lines[i], len(m[1])))
                i += 1
            i = min(i + 1, n)
            info = m[3].strip()
            out.append(Element("code", "\n".join(body), start=at(start), end=at(i - 1), metadata={"language": info.split()[0] if info else None, "fenced": True}))
        elif m := ATX.match(line):
            i += 1
            out.append(_inline_block("heading", (m[2] or "").strip(), at(start), at(start), len(m[1])))
        elif RULE.match(line):
            i += 1
            out.append(Element("thematic_break", start=at(start), end=at(start)))
        elif _indent(line) >= 4:
            while i < n and (not lines[i].strip() or _indent(lines[i]) >= 4):
                i += 1
            while not lines[i - 1].strip():
                i -= 1
            out.append(Element("code", "\n".join(_dedent(x, 4) for x in lines[start:i]), start=at(start), end=at(i - 1), metadata={"language": None, "fenced": False}))
        elif line.lstrip(" ").startswith(">") and _indent(line) < 4:
            body = []
            while i < n and lines[i].strip() and (lines[i].lstrip(" ").startswith(">") or not _starts_block(lines[i])):
                body.append(re.sub(r"^ {0,3}> ?", "", lines[i]))
                i += 1
            out.append(_container("quote", body, at(start), at(i - 1), depth))
        elif m := ITEM.match(line):
            items, i = _items(lines, i, first, depth)
            ordered = m[2][0].isdigit()
            meta = {"ordered": ordered} | ({"start": int(m[2][:-1])} if ordered else {})
            element = Element("list", None, start=at(start), end=items[-1].end, metadata=meta, children=items)
            element.content = [item_text(x) for x in items]
            out.append(element)
        elif m := NOTE.match(line):
            body = [m[2]]
            i += 1
            while i < n and (_indent(lines[i]) >= 4 or (lines[i].strip() and not _starts_block(lines[i]) and not NOTE.match(lines[i]))):
                body.append(_dedent(lines[i], 4))
                i += 1
            note = _container("footnote", body, at(start), at(i - 1), depth)
            note.metadata["label"] = m[1]
            notes.append(note)
        elif HTML.match(line):
            comment = line.lstrip().startswith("<!--")
            while i < n and (lines[i].strip() or comment):
                i += 1
                if comment and "-->" in lines[i - 1]:
                    break
            out.append(Element("html", "\n".join(lines[start:i]), start=at(start), end=at(i - 1)))
        elif i + 1 < n and "|" in line and DELIMITER.match(lines[i + 1]) and "-" in lines[i + 1] and len(cells(line)) == len(cells(lines[i + 1])):
            rows, width = [(line, i)], len(cells(line))
            i += 2
            while i < n and lines[i].strip() and not _starts_block(lines[i]):
                rows.append((lines[i], i))
                i += 1
            made = [_row((cells(x) + [""] * width)[:width], at(k)) for x, k in rows]
            head = Element("table_head", start=at(start), end=at(start), children=made[:1])
            body_ = Element("table_body", start=at(start + 2), end=at(i - 1), children=made[1:])
            out.append(Element("table", [r.content for r in made], start=at(start), end=at(i - 1), children=[head, *([body_] if made[1:] else [])]))
        else:
            i += 1
            level = None
            while i < n and lines[i].strip():
                if s := SETEXT.match(lines[i]):
                    level = 1 if s[1][0] == "=" else 2
                    break
                if _starts_block(lines[i]):
                    break
                i += 1
            text = "\n".join(x.strip() if k + 1 == i - start else x.lstrip() for k, x in enumerate(lines[start:i]))
            i += level is not None
            out.append(_inline_block("heading" if level else "paragraph", text, at(start), at(i - 1), level))
    if notes:
        out.append(Element("footnote_block", start=notes[0].start, end=notes[-1].end, children=notes))
    return out


def _starts_block(line: str) -> bool:
    """Whether a line ends the paragraph before it."""
    item = ITEM.match(line)
    return bool(ATX.match(line) or FENCE.match(line) or RULE.match(line) or HTML.match(line) or line.lstrip(" ").startswith(">") and _indent(line) < 4 or item and item[4] and (not item[2][0].isdigit() or item[2][:-1] == "1"))


def _container(kind: str, body: list[str], start: int, end: int, depth: int) -> Element:
    children = blocks(body, start, depth + 1) if depth < DEPTH else [_inline_block("paragraph", "\n".join(body), start, end, None)]
    element = Element(kind, None, start=start, end=end, children=children)
    element.content = plain(element)
    return element


def _items(lines: list[str], i: int, first: int, depth: int) -> tuple[list[Element], int]:
    """Items of the list that begins at line ``i``, and the line after it."""
    mark = ITEM.match(lines[i])[2]
    kind = mark[-1] if mark[0].isdigit() else mark
    items = []
    while i < len(lines) and (m := ITEM.match(lines[i])) and (m[2][-1] if m[2][0].isdigit() else m[2]) == kind and not RULE.match(lines[i]):
        start = i
        width = len(m[1]) + len(m[2]) + (len(m[3].expandtabs(4)) if m[3] and len(m[3].expandtabs(4)) <= 4 and m[4] else 1)
        body = [(m[4] or "") if not m[3] or len(m[3].expandtabs(4)) <= 4 else m[3].expandtabs(4)[1:] + m[4]]
        i += 1
        gap = False
        while i < len(lines):
            if not lines[i].strip():
                gap = True
                body.append("")
            elif _indent(lines[i]) >= width:
                body.append(_dedent(lines[i], width))
                gap = False
            elif gap or _starts_block(lines[i]) or ITEM.match(lines[i]):
                break
            else:
                body.append(lines[i].lstrip())  # a lazy continuation
            i += 1
        trailing = len(body)
        while body and not body[-1].strip():
            body.pop()
        end = i - 1 - (trailing - len(body))
        task = re.match(r"\[([ xX])\][ \t]+(.*)$", body[0]) if body else None
        if task:
            body[0] = task[2]
        children = blocks(body, first + start, depth + 1) if depth < DEPTH else [_inline_block("paragraph", "\n".join(body), first + start, first + end, None)]
        item = Element("task_list_item" if task else "list_item", None, start=first + start, end=first + max(end, start), children=children)
        if task:
            item.metadata = {"task": True, "checked": task[1] != " "}
        item.content = item_text(item)
        items.append(item)
    return items, i


def _row(texts: list[str], line: int) -> Element:
    made = [_inline_block("table_cell", t, line, line, None) for t in texts]
    return Element("table_row", [c.content for c in made], start=line, end=line, children=made)


def _inline_block(kind: str, text: str, start: int, end: int, level: int | None) -> Element:
    element = Element(kind, None, level, start, end, children=inline(text))
    element.content = plain(element)
    return element


# ---- inline -----------------------------------------------------------------------------------------------------------

TOKEN = re.compile(
    r"\\(?P<escape>[!-/:-@\[-`{-~])|(?P<ticks>`+)|(?P<image>!\[)|(?P<link>\[)|<(?P<auto>[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[^\s<>@]+@[^\s<>@]+\.[^\s<>@]+)>|(?P<html></?[A-Za-z][^<>]*>|<!--.*?-->)"
    r"|(?P<bare>https?://[^\s<]*[^\s<?!.,:*_~'\")])|(?P<hard>(?: {2,}|\\)\n)|(?P<soft>[ \t]*\n[ \t]*)|(?P<mark>\*+|~~|(?<![A-Za-z0-9])_+|_+(?![A-Za-z0-9]))",
    re.DOTALL,
)
TARGET = re.compile(r"\(\s*(<[^<>\n]*>|[^\s()]*(?:\([^\s()]*\)[^\s()]*)*)(?:\s+(\"[^\"]*\"|'[^']*'|\([^()]*\)))?\s*\)")


def _closing(text: str, i: int) -> int:
    """Where the bracket that opened before ``i`` closes, or -1."""
    depth = 1
    while i < len(text):
        if text[i] == "\\":
            i += 1
        elif text[i] == "[":
            depth += 1
        elif text[i] == "]":
            depth -= 1
            if not depth:
                return i
        i += 1
    return -1


def inline(text: str) -> list[Element]:
    out: list[Element] = []
    words: list[str] = []

    def flush() -> None:
        if joined := "".join(words):
            out.append(Element("text", joined))
        words.clear()

    i = 0
    while i < len(text):
        m = TOKEN.search(text, i)
        if not m:
            words.append(text[i:])
            break
        words.append(text[i : m.start()])
        i = m.end()
        kind = m.lastgroup
        if kind == "escape":
            words.append(m["escape"])
        elif kind == "hard":
            words.append("\n")
        elif kind == "soft":
            words.append(" ")
        elif kind == "ticks":
            end = re.compile(rf"(?<!`){m['ticks']}(?!`)").search(text, i)
            if not end:
                words.append(m["ticks"])
                continue
            flush()
            code = text[i : end.start()].replace("\n", " ")
            code = code[1:-1] if len(code) > 1 and code[0] == code[-1] == " " and code.strip() else code
            out.append(Element("code", code, metadata={"inline": True}))
            i = end.end()
        elif kind in ("image", "link"):
            close = _closing(text, i)
            target = TARGET.match(text, close + 1) if close >= 0 else None
            if not target:
                words.append(m[0])
                continue
            flush()
            label, to, title = text[i:close], target[1].strip("<>"), target[2][1:-1] if target[2] else None
            if kind == "image":
                out.append(Element("image", "".join(plain_of(x) for x in inline(label)), metadata={"src": to, "title": title}))
            else:
                children = inline(label)
                out.append(Element("link", "".join(plain_of(x) for x in children if x.type != "html"), metadata={"href": to, "title": title}, children=children))
            i = target.end()
        elif kind in ("auto", "bare"):
            flush()
            shown = m[kind]
            out.append(Element("link", shown, metadata={"href": f"mailto:{shown}" if "@" in shown and "://" not in shown else shown, "title": None}, children=[Element("text", shown)]))
        elif kind == "html":
            flush()
            out.append(Element("html", m["html"], metadata={"inline": True}))
        # marks of emphasis are dropped
    flush()
    return out


def plain_of(element: Element) -> str:
    return element.content if isinstance(element.content, str) else plain(element)


def plain(element: Element) -> str:
    """Text of an element and what is in it; blocks that have segments of their own are left out."""
    skip = {"list", "quote", "table", "html", "metadata", "thematic_break"}
    return "".join(plain_of(c) for c in element.children if c.type not in skip)


def item_text(item: Element) -> str:
    return " ".join(plain_of(c) for c in item.children if c.type in ("paragraph", "heading", "text"))


def parse(text: str) -> list[Element]:
    """Top-level elements of a document; none for an empty one."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    head, begin = front_matter(lines)
    return ([head] if head else []) + blocks(lines[begin:], begin + 1)


# ---- relations --------------------------------------------------------------------------------------------------------

#: Names that the common model does not have become ``other``.
COMMON = frozenset("document heading paragraph list list_item task_list task_list_item code table table_row table_cell quote image link html footnote footnote_block metadata".split())


def rows(text: str) -> Iterator[dict]:
    """The tree as rows in preorder, the document first."""
    root = Element("document", children=parse(text))
    stack: list[tuple[Element, str | None, str | None, int, int]] = [(root, None, None, 0, 0)]
    seq = 0
    while stack:
        e, parent, parent_type, ordinal, depth = stack.pop()
        kind = e.type if e.type in COMMON else "other"
        me = f"e{seq}"
        content = e.content if e.content is None or isinstance(e.content, str) else json.dumps(e.content, ensure_ascii=False)
        meta = dict(e.metadata) | ({"name": e.type} if kind == "other" else {})
        yield {"element_id": me, "parent_id": parent, "parent_type": parent_type, "ordinal": ordinal, "depth": depth, "seq": seq, "type": kind, "level": e.level, "content": content, "start_line": e.start, "end_line": e.end, "metadata": json.dumps(meta, ensure_ascii=False, default=str)}
        stack += [(c, me, kind, k, depth + 1) for k, c in reversed(list(enumerate(e.children)))]
        seq += 1


def elements(docs: DataFrame) -> DataFrame:
    """schemas.ELEMENTS of ``docs`` (source_uri, content): each document's tree in preorder. A failure becomes one row with ``error``."""
    ship(docs.sparkSession)
    fields = [x.split() for x in schemas.ELEMENTS.split(", ")]
    kinds = {"BIGINT": pa.int64(), "INT": pa.int32(), "STRING": pa.string()}
    schema = pa.schema([(n, kinds[t]) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for uri, content in zip(batch.column("source_uri").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    out += [{"source_uri": uri, **r} for r in rows(content or "")]
                except (RecursionError, ValueError) as e:
                    out.append({"source_uri": uri, "seq": 0, "error": f"{type(e).__name__}: {e}"[:300]})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return docs.select("source_uri", "content").mapInArrow(run, schemas.ELEMENTS)


SILENT = ("section", "document", "footnote_block", "container", "list_item", "table_row", "table_cell")


def element_segments(tree: DataFrame) -> DataFrame:
    """Segments of document trees, from any reader: one row per element that emits, in preorder; one projection.

    Lists give the texts of their items, tables their rows (JSON). Names that are not known become ``other``.
    """
    from pyspark.sql import functions as F

    from lodestone.functions.text import location

    meta = lambda k: F.get_json_object("metadata", f"$.{k}")
    emitting = ("heading", "paragraph", "code", "table", "list", "task_list", "quote", "image", "link", "html", "footnote", "metadata")
    kind = F.when(F.col("type").isin(*emitting), F.col("type")).otherwise("other")
    label = (
        F.when(kind == "heading", F.coalesce(F.concat(F.lit("h"), F.col("level").cast("string")), F.lit("heading"))).when(kind == "code", meta("language")).when(kind == "image", F.coalesce(meta("src"), F.lit("image")))
        .when(kind == "link", F.coalesce(meta("href"), F.lit("link"))).when(kind == "footnote", meta("label")).when(kind == "other", F.col("type")).otherwise(kind)
    )
    df = tree.filter(~F.col("type").isin(*SILENT) & F.col("error").isNull())
    return df.select("source_uri", "seq", kind.alias("type"), label.alias("label"), "content", location(F.col("start_line"), F.col("end_line")).alias("location"))


def legacy_segments(tree: DataFrame) -> DataFrame:
    """The older view: nothing inside lists and quotes but them, no inline elements; an image alone in a paragraph is an image; lists with tasks are task lists."""
    from pyspark.sql import functions as F

    segments = element_segments(tree)
    own = tree.select("source_uri", "seq", "element_id", "parent_id", "depth", "metadata")
    parents = tree.select("source_uri", F.col("parent_id").alias("element_id"), "type").groupBy("source_uri", "element_id").agg(F.count("*").alias("n"), F.bool_and(F.col("type") == "image").alias("images"), F.bool_or(F.col("type") == "task_list_item").alias("tasks"))
    df = segments.join(own, ["source_uri", "seq"]).filter("depth = 1").join(parents, ["source_uri", "element_id"], "left")
    lone = (F.col("type") == "paragraph") & (F.col("n") == 1) & F.col("images")
    kind = F.when(lone, "image").when((F.col("type") == "list") & F.coalesce("tasks", F.lit(False)), "task_list").otherwise(F.col("type"))
    return df.select("source_uri", "seq", kind.alias("type"), "label", "content", "location")
