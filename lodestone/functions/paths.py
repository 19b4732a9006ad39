"""Columns over paths: names, suffixes, globs, types, stable ids."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone import schemas


def name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_of(path: Column) -> Column:
    """The directory part; empty for a path without one."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def suffix_of(path: Column) -> Column:
    """Lower-cased suffix with its dot; dotfiles and names without a dot have none."""
    return F.lower(F.regexp_extract(name_of(path), r"^.+(\.[^.]+)$", 1))


def stable_id(path: Column) -> Column:
    """The first 32 hex digits of the path's SHA-256."""
    return F.left(F.sha2(path, 256), F.lit(32))


def content_hash(content: Column, size: Column, most: int | None = None, algorithm: str = "sha256") -> Column:
    """Hex digest of the bytes; null for unread content and above ``most`` bytes."""
    digest = {"sha256": lambda c: F.sha2(c, 256), "sha512": lambda c: F.sha2(c, 512), "sha1": F.sha1, "md5": F.md5}[algorithm](content)
    return digest if most is None else F.when(size <= most, digest)


def glob_regex(pattern: str) -> str:
    """A regular expression, for Java and Python alike, that matches what the shell pattern matches, all of it.

    ``*`` is any run (dots and slashes too), ``?`` any character, ``[..]`` a class and ``[!..]`` its complement; an
    unclosed bracket is itself.
    """
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = pattern.find("]", i + 1 if pattern[i : i + 1] != "!" else i + 2)
            if end < 0:
                out.append(r"\[")
                continue
            body = pattern[i:end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            negate = body.startswith("!")
            body = body[1:] if negate else ("\\" + body if body.startswith("^") else body)
            out.append(f"[{'^' if negate else ''}{body}]")
            i = end + 1
        else:
            out.append(re.escape(c))
    return "(?s)^(?:" + "".join(out) + ")$"


def type_of(path: Column, directory: Column | None = None) -> Column:
    """Artifact type by suffix, then by mime type, else unknown."""
    suffix, mime = suffix_of(path), mime_of(path)
    kind = F.lit("unknown")
    main = F.split_part(mime, F.lit("/"), F.lit(1))
    guess = F.when(_has_mime(path), F.when(main.isin("image", "video", "audio", "text"), main).when(mime == "application/pdf", "pdf").when(mime.isin("application/zip", "application/x-tar", "application/gzip"), "archive"))
    kind = F.coalesce(guess, kind)
    for artifact, suffixes in schemas.SUFFIXES.items():
        kind = F.when(suffix.isin(suffixes.split()), artifact).otherwise(kind)
    return kind if directory is None else F.when(directory, "directory").otherwise(kind)


def category_of(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in schemas.CATEGORIES.items() for x in pair])
    return F.when(kind == "directory", "directory").otherwise(F.coalesce(F.try_element_at(table, kind), F.lit("unknown")))


def _has_mime(path: Column) -> Column:
    return suffix_of(path).isin(list(schemas.MIME_TYPES))


def mime_of(path: Column) -> Column:
    """Mime type by suffix, from the pinned table; text/plain otherwise."""
    table = F.create_map(*[F.lit(x) for pair in schemas.MIME_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, suffix_of(path)), F.lit("text/plain"))


def source_kind(mime: Column) -> Column:
    """Kind of source that a mime type stands for."""
    major = F.split_part(mime, F.lit("/"), F.lit(1))
    text = F.when(mime.contains("markdown"), "markdown").when(mime.contains("html"), "html").otherwise("manual")
    other = F.when(mime.rlike("json|yaml"), "code").when(mime.contains("pdf"), "pdf").when(mime.rlike("wordprocessing|docx"), "docx").otherwise("unknown")
    return F.when(major == "text", text).when(major.isin("image", "audio", "video"), major).otherwise(other)


def module_name(path: Column) -> Column:
    """Dotted name of a Python file."""
    return F.translate(F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", ""), "/", ".")
