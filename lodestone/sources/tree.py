"""A Spark data source that lists a directory tree, hidden and underscored names included, and reads files on demand.

    spark.dataSource.register(TreeSource)
    spark.read.format("tree").option("path", root).option("content", "true").load()

Spark's own file sources leave out every component that starts with ``_`` or ``.``. Options: ``path``; ``follow_symlinks`` and
``include_directories`` (true/false); ``ignore`` (lines of an ignore file; ignored directories are not entered); ``built_in`` (false
to keep what is ignored by default); ``content`` (true to read bytes); ``max_bytes`` (larger files are not read).
Executors walk the tree, one partition per top-level directory, so the path must be the same on all of them.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "relative_path string, absolute_path string, is_directory boolean, is_symlink boolean, size bigint, modified_time timestamp, created_time timestamp, scan_seq bigint, content binary"


class _Part(InputPartition):
    def __init__(self, folder: str | None, number: int):
        super().__init__(number)
        self.folder, self.number = folder, number


class Rules:
    """Ignore rules over relative paths: a user's last fitting rule decides, else built-in names ignore."""

    def __init__(self, lines: list[str], built_in: list[str]):
        from lodestone.functions.paths import glob_regex
        from lodestone.operators.discovery import parse_rules

        def prepared(rules: list[dict]) -> list[tuple]:
            return [(r, [re.compile(glob_regex(g)) for g in r["pattern"].strip("/").split("/")]) for r in rules]

        self.user = prepared(parse_rules(lines, "user"))
        self.own = prepared([r for n in built_in for r in parse_rules([n], "built_in")])

    @staticmethod
    def _last(rules: list[tuple], parts: list[str], directory: bool) -> bool | None:
        verdict = None
        for rule, globs in rules:
            if rule["directory_only"] and not directory:
                continue
            n = len(globs)
            starts = [0] if rule["pattern"].startswith("/") else range(len(parts) - n + 1)
            if any(len(parts) >= s + n and all(g.match(p) for g, p in zip(globs, parts[s : s + n], strict=True)) for s in starts):
                verdict = not rule["negation"]
        return verdict

    def ignored(self, relative: str, directory: bool) -> bool:
        parts = relative.split("/")
        user = self._last(self.user, parts, directory)
        return user if user is not None else bool(self._last(self.own, parts, directory))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        flag = lambda k, d: str(options.get(k, d)).lower() == "true"
        self.root = os.path.abspath(os.path.expanduser(options["path"]))
        self.follow, self.directories, self.content = flag("follow_symlinks", "false"), flag("include_directories", "true"), flag("content", "false")
        self.most = int(options.get("max_bytes", 1 << 30))
        self.lines, self.built_in = options.get("ignore", "").split("\n"), flag("built_in", "true")

    def _rules(self) -> Rules:
        from lodestone import schemas

        return Rules(self.lines, schemas.IGNORED if self.built_in else [])

    def _entries(self, folder: str, rules: Rules) -> tuple[list[os.DirEntry], list[os.DirEntry]]:
        """Kept directories and files of a folder, each by name; an unreadable folder has none."""
        try:
            with os.scandir(os.path.join(self.root, folder)) as it:
                found = sorted(it, key=lambda e: e.name)
        except OSError:
            return [], []
        directories, files = [], []
        for e in found:
            relative = f"{folder}/{e.name}" if folder else e.name
            if rules.ignored(relative, e.is_dir()):
                continue
            if e.is_dir():
                directories.append(e)
            elif e.is_file(follow_symlinks=self.follow):
                files.append(e)
        return directories, files

    def partitions(self) -> list[_Part]:
        directories, _ = self._entries("", self._rules())
        return [_Part(None, 0), *(_Part(e.name, i + 1) for i, e in enumerate(d for d in directories if self.follow or not d.is_symlink()))]

    def read(self, part: _Part) -> Iterator[tuple]:
        rules = self._rules()
        count = 0
        seen: set[tuple[int, int]] = set()

        def row(e: os.DirEntry, folder: str, directory: bool) -> tuple | None:
            nonlocal count
            try:
                info = e.stat(follow_symlinks=self.follow or not e.is_symlink())
            except OSError:
                return None
            count += 1
            path = f"{folder}/{e.name}" if folder else e.name
            moment = lambda s: datetime.fromtimestamp(s, timezone.utc)
            data = None
            if self.content and not directory and info.st_size <= self.most:
                try:
                    with open(e.path, "rb") as f:
                        data = f.read()
                except OSError:
                    data = None
            return (path, os.path.abspath(e.path), directory, e.is_symlink(), 0 if directory else info.st_size, moment(info.st_mtime), moment(getattr(info, "st_birthtime", info.st_ctime)), (part.number << 40) + count, data)

        def walk(folder: str, deeper: bool) -> Iterator[tuple]:
            directories, files = self._entries(folder, rules)
            for e in directories if self.directories else []:
                if r := row(e, folder, True):
                    yield r
            for e in files:
                if r := row(e, folder, False):
                    yield r
            for e in directories if deeper else []:
                if e.is_symlink():
                    if not self.follow:
                        continue
                info = os.stat(e.path)
                if (info.st_ino, info.st_dev) in seen:
                    continue
                seen.add((info.st_ino, info.st_dev))
                yield from walk(f"{folder}/{e.name}" if folder else e.name, True)

        for start in {self.root, os.path.join(self.root, part.folder or "")}:
            info = os.stat(start)
            seen.add((info.st_ino, info.st_dev))
        yield from walk(part.folder or "", part.folder is not None)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def scan(spark: SparkSession, root: str, *, content: bool = False, ignore: list[str] | None = None, follow_symlinks: bool = False, include_directories: bool = True, built_in: bool = True, max_bytes: int = 1 << 30) -> DataFrame:
    """The tree under ``root`` as a DataFrame; see the module for the options."""
    from lodestone.session import ship

    ship(spark)
    spark.dataSource.register(TreeSource)
    options = {"path": str(root), "content": content, "follow_symlinks": follow_symlinks, "include_directories": include_directories, "built_in": built_in, "max_bytes": max_bytes, "ignore": "\n".join(ignore or [])}
    return spark.read.format("tree").options(**{k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}).load()


def read_files(files: DataFrame, algorithm: str = "sha256", max_bytes: int | None = 1 << 30, content: bool = False) -> DataFrame:
    """(relative_path, hash, binary, text, failed) of ``files`` (relative_path, absolute_path, size), opened on the executors.

    Bytes are hashed in chunks, so that only ``content`` holds a whole file in memory; above ``max_bytes`` there is no hash
    and, where ``content`` is asked for, no text but a reason in ``failed``. None is no limit.
    ``binary``: the first 1,024 bytes have a NUL or are not UTF-8. ``text`` is null for binary files; ``failed`` says why a file could not be read.
    """
    import hashlib

    import pyarrow as pa

    from lodestone.session import ship

    ship(files.sparkSession)

    def read(path: str, size: int) -> tuple:
        digest, head, parts = hashlib.new(algorithm), b"", []
        large = max_bytes is not None and size > max_bytes
        try:
            with open(path, "rb") as f:
                while chunk := f.read(1 << 16):
                    head = head or chunk[:1024]
                    if large:
                        break
                    digest.update(chunk)
                    if content:
                        parts.append(chunk)
        except OSError as e:
            return None, None, None, f"{type(e).__name__}: {e}"
        try:
            head.decode("utf-8")
            binary = b"\0" in head
        except UnicodeDecodeError as e:
            binary = b"\0" in head or not (len(head) == 1024 and e.start >= len(head) - 3 and e.reason == "unexpected end of data")
        text = failed = None
        if content and not binary and large:
            failed = f"file of {size} bytes is above the limit of {max_bytes} bytes"
        elif content and not binary:
            try:
                text = b"".join(parts).decode("utf-8")
            except UnicodeDecodeError as e:
                failed = f"UnicodeDecodeError: {e}"
        return None if large else digest.hexdigest(), binary, text, failed

    def run(batches):
        kinds = [pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string()]
        for batch in batches:
            rows = [(r, *read(a, s or 0)) for r, a, s in zip(*(batch.column(c).to_pylist() for c in ("relative_path", "absolute_path", "size")), strict=True)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["relative_path", "hash", "binary", "text", "failed"])

    return files.select("relative_path", "absolute_path", "size").mapInArrow(run, "relative_path string, hash string, binary boolean, text string, failed string")
