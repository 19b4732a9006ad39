"""Columns over texts: titles, keyword types, locations, escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone import schemas

#: Unicode white space, as Java's (?U)\\s and Python's str.strip() take it, less the four separators of ASCII.
BLANK = r"(?U)\s"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"{BLANK}+\z|\A(?U)\s+", "")


def keyword_type(text: Column, default: str | Column) -> Column:
    """The first knowledge type, in the table's order, with a keyword anywhere in the text, else the default.

    The text is looked at once per keyword: where it is costly to compute, pass a column of an earlier projection.
    """
    return keyword_type_of_lowered(F.lower(text), default)


def keyword_type_of_lowered(lowered: Column, default: str | Column) -> Column:
    found = default if isinstance(default, Column) else F.lit(default)
    for kind, keywords in reversed(schemas.KEYWORDS.items()):
        hit = lowered.contains(keywords[0])
        for k in keywords[1:]:
            hit = hit | lowered.contains(k)
        found = F.when(hit, kind).otherwise(found)
    return found


def first_sentence(text: Column) -> Column:
    """Up to the first of . ! ? if something precedes it, else the first 80 characters."""
    own = strip(text)
    sentence = F.regexp_extract(own, r"\A[^.!?]+[.!?]", 0)
    return F.when(sentence != "", strip(sentence)).otherwise(F.left(own, F.lit(80)))


def shortened(text: Column, most: int = 80) -> Column:
    """At most ``most`` characters, the last three of them dots where something was cut."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 3)), F.lit("..."))).otherwise(text)


def location(start: Column, end: Column) -> Column:
    """``line n``, ``lines a-b``, or null without a start."""
    return F.when(start.isNotNull() & end.isNotNull() & (start != end), F.concat(F.lit("lines "), start.cast("string"), F.lit("-"), end.cast("string"))).when(start.isNotNull(), F.concat(F.lit("line "), start.cast("string")))


def line_of(before: Column) -> Column:
    """1-based line of what follows ``before``."""
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def dot_quote(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('\\"')), F.lit('"'))


def dot_label(text: Column) -> Column:
    """At most 80 characters on one line, quotes escaped."""
    return F.replace(F.replace(F.left(text, F.lit(80)), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit(" "))


def cypher_string(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit(" ")), F.lit('"'))


def diagnostic_line(level: Column, code: Column, message: Column) -> Column:
    return F.concat(F.lit("["), F.upper(level), F.lit(":"), code, F.lit("] "), message)
