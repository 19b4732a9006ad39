"""Python sources: components and imports, parsed by the standard library in Python workers."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.session import ship

COMPONENTS = "relative_path string, seq bigint, kind string, id string, title string, name string, full_name string, content string, location string, error string"
IMPORTS = "relative_path string, statement int, candidates array<string>"


def module_of(path: str) -> str:
    folder, _, name = path.rpartition("/")
    stem = name.rpartition(".")[0] or name
    return (f"{folder}/{stem}" if folder else stem).replace("/", ".")


def _excerpt(source: str, lines: list[str], node: ast.AST) -> str:
    text = ast.get_source_segment(source, node)
    return text.strip() if text else "\n".join(lines[node.lineno - 1 : node.end_lineno])


def components(source: str, path: str) -> Iterator[dict]:
    """Top-level functions and classes, methods of those classes, and simple assignments, in order."""
    lines, module = source.splitlines(), module_of(path)

    def made(kind: str, title: str, name: str, full: str, node: ast.AST) -> dict:
        return {"kind": kind, "id": f"ku://comp/{module}/{kind}/{full}", "title": title, "name": name, "full_name": full, "content": _excerpt(source, lines, node), "location": f"line {node.lineno}"}

    functions = (ast.FunctionDef, ast.AsyncFunctionDef)
    for node in ast.parse(source, filename=path).body:
        match node:
            case ast.FunctionDef() | ast.AsyncFunctionDef():
                yield made("func", f"def {node.name}()", node.name, node.name, node)
            case ast.ClassDef():
                yield made("class", f"class {node.name}", node.name, node.name, node)
                for child in node.body:
                    if isinstance(child, functions):
                        full = f"{node.name}.{child.name}"
                        yield made("func", f"method {full}()", child.name, full, child)
            case ast.Assign():
                for target in node.targets:
                    if isinstance(target, ast.Name):
                        title = f"{target.id} = {ast.unparse(node.value)}"
                        yield made("var", title if len(title) <= 80 else title[:77] + "...", target.id, target.id, node)


def import_candidates(source: str, path: str) -> Iterator[list[str]]:
    """For each top-level import, the project files that it may mean, best first.

    ``import a, b`` may mean a.py, then b.py (dots are kept). ``from x.y import z`` means x/y.py or x/y/__init__.py. A relative import starts at
    the file's package; without a module it means the first name.
    """
    folders = path.split("/")[:-1]
    for node in ast.parse(source, filename=path).body:
        if isinstance(node, ast.Import):
            yield [f"{alias.name}.py" for alias in node.names]
        elif isinstance(node, ast.ImportFrom):
            if node.level:
                up = node.level - 1
                if up > len(folders):
                    yield []
                    continue
                base = folders[: len(folders) - up] + (node.module.split(".") if node.module else [node.names[0].name])
            else:
                base = node.module.split(".")
            yield ["/".join(base) + ".py", "/".join([*base, "__init__.py"])]


def parse_components(files: DataFrame) -> DataFrame:
    """Components of ``files`` (relative_path, content). A file that cannot be parsed gives one row with ``error``.

    Of components with the same id, as when a function is defined twice, all are returned; first_of_each() keeps the first.
    """
    ship(files.sparkSession)
    names = [x.split()[0] for x in COMPONENTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.int64() if n == "seq" else pa.string()) for n in names])
        for batch in batches:
            out = []
            for path, content in zip(batch.column("relative_path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    out += [{"relative_path": path, "seq": i, **c} for i, c in enumerate(components(content or "", path))]
                except (SyntaxError, ValueError, RecursionError) as e:
                    out.append({"relative_path": path, "seq": 0, "error": f"{type(e).__name__}: {e}"[:500]})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return files.select("relative_path", "content").mapInArrow(run, COMPONENTS)


def parse_imports(files: DataFrame) -> DataFrame:
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("relative_path", pa.string()), ("statement", pa.int32()), ("candidates", pa.list_(pa.string()))])
        for batch in batches:
            out = []
            for path, content in zip(batch.column("relative_path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    out += [{"relative_path": path, "statement": i, "candidates": c} for i, c in enumerate(import_candidates(content or "", path))]
                except (SyntaxError, ValueError, RecursionError):
                    continue  # parse_components() reports it
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return files.select("relative_path", "content").mapInArrow(run, IMPORTS)


def first_of_each(found: DataFrame) -> DataFrame:
    """One component per id: the first in its file."""
    from pyspark.sql import functions as F

    row = F.struct(*[c for c in found.columns if c != "id"])
    return found.filter("error IS NULL").groupBy("id").agg(F.min_by(row, F.struct("relative_path", "seq")).alias("r")).select("id", "r.*")
