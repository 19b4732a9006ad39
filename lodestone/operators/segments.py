"""Segments of texts and of JSON: headings, paragraphs, code, tables, sentences, structure.

Every function takes ``docs`` (source_uri, content) and returns (source_uri, seq, type, label, content, location); seq orders
the segments of one document within one function. All but ``structure`` are built-in functions over one row: no shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import line_of, strip

COLUMNS = ("source_uri", "seq", "type", "label", "content", "location")
#: Ends of lines: \\n, \\r, \\r\\n, and the rarer Unicode and ASCII ones.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def lines_of(text: Column) -> Column:
    """The lines of a text; a last line end adds none."""
    return _let(F.split(text, LINE_END), lambda ls: F.when(F.try_element_at(ls, F.lit(-1)) == "", F.slice(ls, 1, F.size(ls) - 1)).otherwise(ls))


def _rows(docs: DataFrame, found: Column, kind: str) -> DataFrame:
    """One row per struct (label, content, location) of the array ``found``."""
    df = docs.select("source_uri", F.posexplode(found).alias("pos", "s"))
    return df.select("source_uri", F.col("pos").cast("long").alias("seq"), F.lit(kind).alias("type"), F.col("s.label").alias("label"), F.col("s.content").alias("content"), F.col("s.location").alias("location"))


def _segment(label: Column, content: Column, location: Column) -> Column:
    return F.struct(label.cast("string").alias("label"), content.cast("string").alias("content"), location.cast("string").alias("location"))


def _where(prefix: str, n: Column, after: str = "") -> Column:
    return F.concat(F.lit(prefix), n.cast("string"), F.lit(after))


def _runs(places: Column) -> Column:
    """(first, last) of each run of consecutive numbers in a sorted array."""

    def ends(p: Column) -> Column:
        first = F.filter(p, lambda x, j: (j == 0) | (F.get(p, j - 1) != x - 1))
        last = F.filter(p, lambda x, j: (j == F.size(p) - 1) | (F.get(p, j + 1) != x + 1))
        return F.arrays_zip(first.alias("first"), last.alias("last"))

    return _let(places, ends)


def _places(array: Column, test) -> Column:
    """Places, from 0, at which ``test`` holds."""
    return F.transform(F.filter(F.transform(array, lambda x, i: F.struct(test(x).alias("t"), i.alias("i"))), lambda x: x.getField("t")), lambda x: x.getField("i"))


def _below(sorted_places: Column, x: Column) -> Column:
    """How many elements of a sorted array are below ``x``: a binary search of 32 steps at most."""
    steps = F.transform(F.sequence(F.lit(30), F.lit(0), F.lit(-1)), lambda k: F.pow(F.lit(2), k).cast("int"))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= F.size(sorted_places)) & (F.get(sorted_places, at + step - 1) < x), at + step).otherwise(at))


def _line_ends(parts: Column) -> Column:
    """The place of the part of each line end in the parts, in order."""
    return F.flatten(F.transform(parts, lambda p, i: F.array_repeat(i, _newlines(p))))


def headings(docs: DataFrame) -> DataFrame:
    """Lines with one to six ``#``, then lines that ``=`` or ``-`` underline; an underline that has served cannot be a heading itself.

    Among consecutive underlines, the first serves the line above it, the third the second, and so on.
    """
    atx_line = r"(?dU)^#{1,6}\s+.+$"

    def found(ls: Column) -> Column:
        atx = F.transform(_places(ls, lambda line: line.rlike(atx_line)), lambda i: F.struct(F.get(ls, i).alias("line"), i.alias("i")))
        atx = F.transform(atx, lambda x: _segment(F.concat(F.lit("h"), F.length(F.regexp_extract(x.getField("line"), "^(#+)", 1)).cast("string")), strip(F.regexp_extract(x.getField("line"), r"(?dU)^#{1,6}\s+(.+?)(?:\s+#*)?$", 1)), _where("line ", x.getField("i") + 1)))
        under = _runs(_places(ls, lambda line: strip(line).rlike(r"\A(?:=+|-+)\z")))
        # a run at the very top has no line above its first underline
        first = lambda r: F.when(r.getField("first") == 0, 1).otherwise(r.getField("first"))
        serving = F.flatten(F.transform(under, lambda r: F.when(first(r) <= r.getField("last"), F.sequence(first(r), r.getField("last"), F.lit(2))).otherwise(F.array().cast("array<int>"))))
        level = lambda i: F.when(strip(F.get(ls, i)).startswith("="), "h1").otherwise("h2")
        return F.concat(atx, F.transform(serving, lambda i: _segment(level(i), strip(F.get(ls, i - 1)), _where("line ", i))))

    return _rows(docs, _let(lines_of(F.col("content")), found), "heading")


def paragraphs(docs: DataFrame) -> DataFrame:
    """Blocks between blank lines, less headings, fences and tables. A single blank line at the top belongs to the first block."""

    def structural(b: Column) -> Column:
        ls = lines_of(b)
        return b.startswith("#") | b.startswith("```") | b.endswith("```") | (F.forall(ls, lambda x: x.contains("|")) & F.exists(ls, lambda x: x.contains("-")))

    def found(ls: Column) -> Column:
        full = _places(ls, lambda line: strip(line) != "")
        block = lambda r: strip(F.array_join(F.slice(ls, r.getField("first") + 1, r.getField("last") - r.getField("first") + 1), "\n"))
        line = lambda r: F.when(r.getField("first") == 1, 1).otherwise(r.getField("first") + 1)
        return F.transform(_runs(full), lambda r: F.struct(block(r).alias("b"), line(r).alias("line")))

    blocks = F.filter(_let(F.split(F.col("content"), "\n"), found), lambda x: ~structural(x.getField("b")))
    return _rows(docs, F.transform(blocks, lambda x: _segment(F.lit(None), x.getField("b"), _where("line ", x.getField("line")))), "paragraph")


def _newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def code_blocks(docs: DataFrame) -> DataFrame:
    """Fenced blocks with their language; the n-th block of a document says so."""
    fence = r"(?s)```[ \t]*((?U:\w+))?[ \t]*\r?\n(.*?)```"
    text = F.col("content")
    blocks = F.regexp_extract_all(text, F.lit(fence), F.lit(0))

    def found(ws: Column) -> Column:
        def placed(inside: Column) -> Column:
            # line ends before block i: those of the texts 0 to i between blocks, and of the blocks before it
            return _let(_line_ends(F.split(text, fence)), lambda between: F.transform(ws, lambda w, i: describe(w, i, _below(between, i + 1) + _below(inside, i) + 1)))

        return _let(_line_ends(ws), placed)

    def describe(w: Column, i: Column, line: Column) -> Column:
        language = F.regexp_extract(w, fence, 1)
        code = F.btrim(F.regexp_extract(w, fence, 2), F.lit("\n"))
        return _segment(F.when(language != "", language), code, F.concat(F.lit("code block "), (i + 1).cast("string"), F.lit(" (line "), line.cast("string"), F.lit(")")))

    return _rows(docs.filter(text.contains("```")), _let(blocks, found), "code")


def table_cells(line: Column) -> Column:
    """Cells of a row; a bar at either edge makes no cell."""
    cells = F.transform(F.split(line, r"\|"), strip)
    cells = _let(cells, lambda c: F.when(line.startswith("|") & (F.size(c) > 0) & (F.get(c, F.lit(0)) == ""), F.slice(c, 2, F.size(c))).otherwise(c))
    return _let(cells, lambda c: F.when(line.endswith("|") & (F.size(c) > 0) & (F.try_element_at(c, F.lit(-1)) == ""), F.slice(c, 1, F.size(c) - 1)).otherwise(c))


def tables(docs: DataFrame) -> DataFrame:
    """Runs of lines with a bar, as JSON arrays of rows; separator rows are left out, and runs of nothing else."""
    separator = lambda line: line.rlike(r"\A[-:| \t]*\z") & line.contains("-") & line.contains("|")

    def found(ls: Column) -> Column:
        def rows(r: Column) -> Column:
            lines = F.slice(ls, r.getField("first") + 1, r.getField("last") - r.getField("first") + 1)
            return F.filter(F.transform(F.filter(lines, lambda x: ~separator(x)), table_cells), lambda c: F.size(c) > 0)

        return F.transform(_runs(_places(ls, lambda line: line.contains("|"))), lambda r: F.struct(r.getField("first").alias("first"), r.getField("last").alias("last"), rows(r).alias("rows")))

    blocks = F.filter(_let(lines_of(F.col("content")), found), lambda b: F.size(b.getField("rows")) > 0)
    return _rows(docs, F.transform(blocks, lambda b: _segment(F.lit("table"), F.to_json(b.getField("rows")), F.concat(F.lit("lines "), (b.getField("first") + 1).cast("string"), F.lit("-"), (b.getField("last") + 1).cast("string")))), "table")


def sentences(docs: DataFrame) -> DataFrame:
    """Pieces that end in . ! or ? before white space; the line is 1, and one more for each piece and each line end within pieces before."""
    parts = F.filter(F.transform(F.split(strip(F.col("content")), r"(?<=[.!?])(?U:\s+)"), strip), lambda s: s != "")
    found = _let(parts, lambda ps: _let(_line_ends(ps), lambda ends: F.transform(ps, lambda s, i: _segment(F.lit(None), s, _where("line ", _below(ends, i) + i + 1)))))
    return _rows(docs, found, "semantic")


def text_segments(docs: DataFrame, semantic: bool = False) -> DataFrame:
    """What plain texts yield: headings, paragraphs, code, tables, in this order; sentences too if asked for."""
    makers = [headings, paragraphs, code_blocks, tables, *([sentences] if semantic else [])]
    parts = [m(docs).withColumn("stage", F.lit(i)) for i, m in enumerate(makers)]
    return reduce(DataFrame.unionByName, parts)
