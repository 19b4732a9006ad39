"""A directory from inventory to graph, the command line, sources, configuration, plugins, events."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.config import load
from lodestone.engine import OUTPUTS, Engine
from lodestone.operators import graph, markdown, pycode
from lodestone.plugins import Registry
from lodestone.sources import catalog, tree
from lodestone.sources.workspace import Workspace
from lodestone.streaming.events import DiscoveryCompleted, Event, EventBus

FILES = {
    "README.md": "# Decision: use Spark\n\nWe decided it. It must work.\n\n| A | B |\n|---|---|\n| 1 | 2 |\n",
    "pkg/__init__.py": '"""doc only"""\n',
    "pkg/a.py": "import os\nfrom . import b\nfrom pkg.b import thing\n\nX = 1\n\n\ndef f():\n    return 1\n\n\nclass K:\n    def m(self):\n        pass\n",
    "pkg/b.py": "from .a import f\n\n\nasync def thing():\n    pass\n\n\ndef thing():\n    pass\n",
    "pkg/bad.py": "def (:\n",
    "data/config.json": '{"name": "Alice", "tags": ["x", "y"], "on": false}',
    "data/broken.json": "{",
    "data/notes.txt": "Title\n=====\n\nA risk is here. Another one!\n",
    "assets/logo.png": b"\x89PNG\x00\x01",
    "blob": b"\x00\x01\x02",
    "node_modules/x/index.js": "ignored",
    ".hidden/_x.txt": "kept",
    "skip.me": "ignored by rule",
    ".lodestoneignore": "# rules\n*.me\n",
}


@pytest.fixture
def project(tmp_path):
    for name, body in FILES.items():
        p = tmp_path / "proj" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body if isinstance(body, bytes) else body.encode())
    return tmp_path / "proj"


def test_tree(spark, project):
    os.symlink(project / "pkg", project / "linkdir")
    os.symlink(project / "README.md", project / "link.md")
    rows = tree.scan(spark, project, ignore=["*.me"]).orderBy("scan_seq").collect()
    paths = [r.relative_path for r in rows]
    assert "node_modules" not in paths and "node_modules/x/index.js" not in paths and "skip.me" not in paths
    assert {"pkg/__init__.py", ".hidden/_x.txt", "linkdir"} <= set(paths) and "link.md" not in paths and "linkdir/a.py" not in paths
    top = [p for p in paths if "/" not in p]
    directories = [p for p in top if (project / p).is_dir()]
    assert top == sorted(directories) + sorted(set(top) - set(directories))
    followed = {r.relative_path for r in tree.scan(spark, project, follow_symlinks=True).collect()}
    assert {"link.md", "linkdir/a.py"} <= followed
    content = {r.relative_path: r.content for r in tree.scan(spark, project, content=True, built_in=False).collect()}
    assert bytes(content["node_modules/x/index.js"]) == b"ignored" and content["pkg"] is None


def test_symlink_cycle_ends(spark, project):
    os.symlink(project, project / "pkg" / "loop")
    paths = [r.relative_path for r in tree.scan(spark, project, follow_symlinks=True).collect()]
    assert len(paths) == len(set(paths))


def test_discover_twice(spark, project):
    bus, seen = EventBus(), []
    bus.subscribe(DiscoveryCompleted, seen.append)
    engine = Engine(spark, bus=bus)
    first = engine.discover(project)
    rows = {r.relative_path: r for r in first.artifacts.collect()}
    assert "blob" not in rows and "assets/logo.png" in rows and rows["pkg"].type == "directory" and rows["pkg/a.py"].type == "source_code"
    assert set(first.tallies) == {"new"}
    (project / "data/notes.txt").write_text("changed and longer than before\n")
    os.rename(project / "README.md", project / "READ.md")
    (project / "pkg/bad.py").unlink()
    second = engine.discover(project)
    status = {r.relative_path: (r.status, r.previous_path) for r in second.changes.collect()}
    assert status["data/notes.txt"][0] == "modified" and status["READ.md"] == ("renamed", "README.md") and status["pkg/bad.py"][0] == "deleted" and status["pkg/a.py"][0] == "unchanged"
    assert len(seen) == 2 and seen[1].renamed == 1 and seen[1].deleted == 1


def test_analyze(spark, project):
    engine = Engine(spark)
    a = engine.analyze(project)
    objects = {r.id: r for r in a.objects.collect()}
    assert objects["ku://comp/pkg.a/class/K"].title == "class K" and "ku://comp/pkg.a/func/K.m" in objects and objects["ku://comp/pkg.a/var/X"].title == "X = 1"
    assert objects["ku://comp/pkg.b/func/thing"].content.startswith("async def")
    assert objects["ku://file/pkg/a.py"].title == "pkg.a" and "ku://file/pkg/__init__.py" not in objects
    assert "Decision: use Spark" in {o.title for o in objects.values()}
    types = {o.title: o.type for o in objects.values()}
    assert types["Decision: use Spark"] == "decision" and types["Title"] == "goal" and types["A risk is here."] == "risk"
    edges = {(r.relationship_type, r.source_id, r.target_id) for r in a.edges.collect()}
    assert ("depends_on", "ku://file/pkg/a.py", "ku://file/pkg/b.py") in edges and ("contains", "ku://file/pkg/a.py", "ku://comp/pkg.a/func/f") in edges
    codes = {r.code for r in a.diagnostics.collect()}
    assert {"python_parse_failed", "extraction_failed", "cycle", "skipped_artifact"} <= codes and not a.ok
    assert a.statistics["cycle_count"] == 1
    space = engine.workspace(project)
    assert all(space.path(x).exists() for x in OUTPUTS)
    summary = space.read_json("reports/summary.json")
    assert summary["object_count"] == len(objects) and not summary["ok"]
    nodes, again = engine.load_graph(project)
    assert nodes.count() == len(objects) and {(r.relationship_type, r.source_id, r.target_id) for r in again.collect()} == edges
    kinds = {json.loads(x)["kind"] for x in space.path("knowledge/catalog.jsonl").read_text().splitlines()}
    assert kinds == {"KnowledgeType", "RelationshipType", "EvidenceType", "KnowledgeObject", "KnowledgeRelationship", "metadata"}
    found, _ = engine.query(graph.GraphQuery(node_type="decision"), nodes, again)
    assert found.count() >= 1
    for known in (a.nodes, nodes):  # as analysed, and as loaded
        found, _ = engine.query(graph.GraphQuery(metadata={"language": "python", "full_name": "K.m"}), known, again)
        assert [r.id for r in found.collect()] == ["ku://comp/pkg.a/func/K.m"]
    assert objects["ku://file/pkg/a.py"].metadata["relative_path"] == "pkg/a.py" and objects["ku://comp/pkg.a/class/K"].metadata == {"language": "python", "name": "K"}


def test_command_line(spark, project, capsys):
    from lodestone import cli

    assert cli.main(["version"]) == 0 and cli.main(["discover", str(project / "none")]) == 2
    assert cli.main(["report", "summary", str(project)]) == 1
    assert cli.main(["init", str(project)]) == 0 and cli.main(["init", str(project)]) == 1 and cli.main(["init", str(project), "--force"]) == 0
    assert cli.main(["doctor", str(project), "--json"]) == 0
    capsys.readouterr()
    assert cli.main(["discover", str(project), "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["new"] > 5
    assert cli.main(["analyze", str(project), "--json"]) == 4
    assert json.loads(capsys.readouterr().out)["object_count"] > 5
    assert cli.main(["export", "dot", str(project)]) == 0
    out = capsys.readouterr().out
    assert out.startswith("digraph G {") and out.rstrip().endswith("}")
    for kind in ("summary", "structure", "graph"):
        assert cli.main(["report", kind, str(project), "--json"]) == 0
        json.loads(capsys.readouterr().out)


def test_catalog_round_trip(spark, tmp_path):
    objects = spark.createDataFrame([("a", "risk", "A", ["x"]), ("b", "goal", None, None)], "id string, type string, title string, tags array<string>")
    relationships = spark.createDataFrame([("r", "supports", "a", "b")], "id string, relationship_type string, from_id string, to_id string")
    path = f"file://{tmp_path}/catalog"
    catalog.write_jsonl(catalog.catalog_lines({"objects": objects, "relationships": relationships}), path)
    more = spark.createDataFrame([("a", "risk", "A2", ["y"])], objects.schema)
    back = catalog.read_catalog(spark, path, {"objects": "id string, type string, title string, tags array<string>", "relationships": "id string, relationship_type string, from_id string, to_id string"})
    assert sorted(map(str, back["objects"].collect())) == sorted(map(str, objects.collect())) and back["relationships"].count() == 1
    catalog.write_jsonl(catalog.records(more, "KnowledgeObject"), f"file://{tmp_path}/catalog2")
    spark.createDataFrame([('{"kind": "Odd", "data": {}}',)], "value string").write.text(f"file://{tmp_path}/odd")
    with pytest.raises(ValueError):
        catalog.read_catalog(spark, f"file://{tmp_path}/odd", {})
    for form, text in (("json", catalog.to_json(objects)), ("yaml", catalog.to_yaml(objects))):
        assert sorted(map(str, catalog.from_text(spark, text, "id string, type string, title string, tags array<string>", form).collect())) == sorted(map(str, objects.collect()))
    assert catalog.read_jsonl(spark, f"file://{tmp_path}/none", "id string").count() == 0


def test_workspace(tmp_path):
    w = Workspace(tmp_path / "w")
    w.init("p")
    with pytest.raises(ValueError):
        w.write_lines("../x", ["a"])
    with w.unit() as unit:
        unit.stage("reports/a.txt", "hello")
        unit.commit()
    assert w.path("reports/a.txt").read_text() == "hello\n" and w.read_json("workspace.json")["artifacts"] == ["reports/a.txt"]
    with w.unit() as unit:
        unit.stage("b.txt", "x")
    assert not w.path("b.txt").exists()
    w.append_json("log.jsonl", {"a": 1})
    assert w.read_jsonl("log.jsonl") == [{"a": 1}] and w.read_jsonl("none.jsonl") == []


def test_config(tmp_path):
    (tmp_path / "lodestone.yaml").write_text("project_name: p\ndiscovery:\n  max_file_size: 5\n")
    c = load(tmp_path, {"log_level": "debug"}, tmp_path / "none.yaml", {"LODESTONE_DISCOVERY__FOLLOW_SYMLINKS": "yes", "LODESTONE_WORKSPACE_DIR": "w"})
    assert (c.project_name, c.log_level, c.workspace_dir) == ("p", "DEBUG", "w") and c.discovery["max_file_size"] == 5 and c.discovery["follow_symlinks"] is True and c.discovery["include_directories"] is True
    with pytest.raises(ValueError):
        load(tmp_path, {"log_level": "loud"})
    (tmp_path / "lodestone.yaml").write_text("- a\n")
    with pytest.raises(ValueError):
        load(tmp_path)


def test_plugins(tmp_path):
    for name, api, body in (("good", "1", "def register(api):\n    api.register('segmenter', lambda docs: docs)\n"), ("old", "0", ""), ("broken", "1", "raise RuntimeError('no')")):
        d = tmp_path / name
        d.mkdir()
        (d / "plugin.yaml").write_text(f"name: {name}\nplugin_api_version: '{api}'\nentry_point: mod:register\nports: [segmenter]\nextra: 1\n")
        (d / "mod.py").write_text(body)
    r = Registry()
    r.load_all([str(tmp_path)])
    assert [m.name for m in r.plugins] == ["good"] and len(r.errors) == 2 and len(r.resolve("segmenter")) == 1
    with pytest.raises(TypeError):
        r.register("reader", 3)


def test_events(spark):
    bus, got = EventBus(), []
    bus.subscribe(Event, got.append)
    bus.publish(DiscoveryCompleted(added=1))
    bus.publish(Event())
    assert len(got) == 1 and bus.frame(spark).count() == 2


MARKDOWN = """---
title: x
---
# Title

Para with [link](http://a.b "t"), **bold** `code` <b>h</b>.

- one
- [x] two
  - deep

> quote
> more

```py
x=1
```

| A | B |
|---|---|
| 1 | 2 |

![alt](src.png)

Text[^1]

[^1]: note

<div>x</div>

Sub
---
"""


def test_markdown(spark):
    docs = spark.createDataFrame([("d.md", MARKDOWN), ("e.md", ""), ("n.md", None), ("bad.md", "---\nbroken: [\n---\n# T")], "source_uri string, content string")
    tree_ = markdown.elements(docs)
    rows = tree_.collect()
    own = [r for r in rows if r.source_uri == "d.md"]
    top = [(r.type, r.start_line, r.end_line) for r in sorted(own, key=lambda r: r.seq) if r.depth == 1]
    assert top == [("metadata", 1, 3), ("heading", 4, 4), ("paragraph", 6, 6), ("list", 8, 10), ("quote", 12, 13), ("code", 15, 17), ("table", 19, 21), ("paragraph", 23, 23), ("paragraph", 25, 25), ("html", 29, 29), ("heading", 31, 32), ("footnote_block", 27, 27)]
    assert len([r for r in rows if r.source_uri == "e.md"]) == 1
    assert "parse_error" in [r for r in rows if r.source_uri == "bad.md" and r.type == "metadata"][0].metadata
    segments = markdown.element_segments(tree_).filter("source_uri = 'd.md'").collect()
    by = {}
    for s in segments:
        by.setdefault(s.type, []).append(s)
    assert [s.label for s in by["heading"]] == ["h1", "h2"] and json.loads(by["table"][0].content) == [["A", "B"], ["1", "2"]] and json.loads(by["list"][0].content) == ["one", "two"]
    assert by["link"][0].label == "http://a.b" and by["image"][0].label == "src.png" and by["footnote"][0].label == "1" and by["code"][-1].label == "py"
    legacy = {s.type for s in markdown.legacy_segments(tree_).filter("source_uri = 'd.md'").collect()}
    assert {"task_list", "image", "quote", "html", "metadata", "table", "code"} <= legacy
    from lodestone.operators.knowledge import check_elements

    assert check_elements(tree_).filter("level = 'error'").count() == 0


def test_large_markdown(spark):
    docs = spark.createDataFrame([("big.md", "\n\n".join(f"## H {i}\n\nParagraph {i}." for i in range(500)))], "source_uri string, content string")
    assert markdown.legacy_segments(markdown.elements(docs)).count() == 1000


def test_element_rules(spark):
    from lodestone.operators.knowledge import check_elements

    def tree_of(child, parent):
        rows = [("u", "e0", None, None, 0, 0, 0, "document", None, None, 1, 2, "{}", None), ("u", "e1", "e0", "document", 0, 1, 1, parent, None, None, 1, 2, "{}", None), ("u", "e1" if child == "twice" else "e2", "e1", parent, 0, 2, 2, "odd" if child == "twice" else child, None, None, 3, 2, "{}", None)]
        return spark.createDataFrame(rows, schemas.ELEMENTS)

    codes = lambda t: {r.code for r in check_elements(t).collect()}
    assert "invalid_child_element" in codes(tree_of("paragraph", "list")) and "invalid_child_element" not in codes(tree_of("list_item", "list"))
    assert {"duplicate_element_id", "unsupported_element_type", "invalid_location"} <= codes(tree_of("twice", "quote"))


def test_python_components():
    found = list(pycode.components("x = y = 1\nz: int = 2\ndef f():\n    def g(): pass\n", "a/b.py"))
    assert [c["id"] for c in found] == ["ku://comp/a.b/var/x", "ku://comp/a.b/var/y", "ku://comp/a.b/func/f"]
    assert list(pycode.import_candidates("import a.b, c\nfrom ..x import y\nfrom .. import z\nfrom m.n import o\n", "p/q/r.py")) == [["a.b.py", "c.py"], ["p/x.py", "p/x/__init__.py"], ["p/z.py", "p/z/__init__.py"], ["m/n.py", "m/n/__init__.py"]]


def test_structure(spark):
    from lodestone.operators.structure import structure

    docs = spark.createDataFrame([("a", '{"name":"Alice","tags":["x",{"k":1}],"o":{"p":null}}', "application/json"), ("b", "a: 1\nb: [2]\n", "application/yaml"), ("c", "3", "application/json"), ("d", "{", "application/json")], "source_uri string, content string, mime_type string")
    rows = structure(docs).orderBy("source_uri", "seq").collect()
    assert [(r.label, r.content) for r in rows if r.source_uri == "a"] == [("name", "Alice"), ("tags[0]", "x"), ("tags[1]", '{"k": 1}'), ("tags[1].k", "1"), ("o", '{"p": null}'), ("o.p", None)]
    assert [(r.label, r.content) for r in rows if r.source_uri == "b"] == [("a", "1"), ("b[0]", "2")] and [r.label for r in rows if r.source_uri == "c"] == ["root"] and [r.error for r in rows if r.source_uri == "d"][0]


def test_type_schema(spark):
    from lodestone.operators import knowledge as K

    types = spark.createDataFrame([("t", "T", "x", json.dumps({"required": ["status"], "properties": {"status": {"type": "string"}, "n": {"type": "integer"}}}))], schemas.KNOWLEDGE_TYPES)
    objects = spark.createDataFrame([("1", "t", "{}"), ("2", "t", '{"status": "open", "n": 1}'), ("3", "t", '{"status": 123, "n": true}'), ("4", "t", None), ("5", "t", "[1]"), ("6", "u", None)], "id string, type string, content string")
    got = sorted((r.source_ref, r.code) for r in K.check_types(objects, types).collect())
    assert got == [("1", "missing_required_field"), ("3", "field_type_mismatch"), ("3", "field_type_mismatch"), ("4", "missing_content"), ("5", "invalid_content_shape"), ("6", "unknown_knowledge_type")]


def test_stats_of_graph(spark):
    nodes = spark.createDataFrame([("a", "component"), ("b", "component"), ("c", "component"), ("d", "risk")], "id string, type string")
    edges = spark.createDataFrame([("1", "depends_on", "a", "b", True), ("2", "depends_on", "b", "c", True), ("3", "depends_on", "c", "a", True)], "id string, relationship_type string, source_id string, target_id string, directed boolean")
    s = graph.statistics(nodes, edges)
    assert (s["cycle_count"], s["orphan_count"], s["connected_component_count"], s["node_count"]) == (1, 1, 2, 4) and s["density"] == 0.25
    assert graph.statistics(nodes.limit(0), edges.limit(0))["average_in_degree"] == 0.0
    assert graph.shortest_path(nodes, edges, "a", "c") == ["a", "b", "c"] and graph.shortest_path(nodes, edges, "a", "d") == [] and graph.has_path(nodes, edges, "d", "d")
    assert [r.id for r in graph.dfs(nodes, edges, "a").orderBy("visit").collect()] == ["a", "b", "c"]
    with pytest.raises(ValueError):
        graph.traverse(graph.Traversal("a", "sideways"), nodes, edges)


def test_graph_from_objects(spark):
    empty = "cast(null as string)"
    ref = "named_struct('ref', '{0}', 'kind', 'knowledge_object', 'label', {1}, 'version', {1})"
    objects = spark.range(2).select(
        F.concat(F.lit("o"), F.col("id").cast("string")).alias("id"), F.lit("risk").alias("type"), F.lit("T").alias("title"), F.lit(None).cast("string").alias("description"),
        F.expr("array(named_struct('uri', 'u1'))").alias("sources"), F.expr(f"array({ref.format('o0', empty)}, {ref.format('o0', empty)})").alias("references"), F.expr(f"named_struct('project_id', 'p', 'domain', {empty}, 'custom', map('k', 'v'))").alias("metadata"),
        F.expr("named_struct('state', 'draft')").alias("lifecycle"), F.expr("named_struct('value', 0.5D)").alias("confidence"), F.expr("array('dom')").alias("domain_tags"), F.expr("array('tag')").alias("tags"),
    )
    rel = spark.range(1).select(F.lit("r").alias("id"), F.lit("related_to").alias("relationship_type"), F.expr(ref.format("o0", empty)).alias("from_ref"), F.expr(ref.format("o1", empty)).alias("to_ref"), F.expr("array(1, 2)").alias("evidence"), F.expr("named_struct('value', 1.0D)").alias("confidence"))
    from lodestone.operators.knowledge import relationship_types

    nodes, edges = graph.build(objects, rel, relationship_types(spark))
    n = nodes.orderBy("id").first()
    assert n.labels == ["risk", "dom", "tag"] and n.properties.tags == ["tag", "dom"] and n.properties.source == "u1" and n.metadata == {"k": "v"}
    e = {r.id: r for r in edges.collect()}
    assert set(e) == {"r", "ref:o0->o0", "ref:o1->o0"} and not e["r"].directed and e["r"].properties.evidence_count == 2
    assert [r.id for r in graph.neighbors(edges, "o1").orderBy("id").collect()] == ["o0"]


def test_graph_object(spark, tmp_path):
    from lodestone.api import Graph, Knowledge

    nodes = spark.createDataFrame([("a", "decision", "Use it", ["decision", "db"]), ("b", "technology", "It", ["technology", "db"]), ("c", "requirement", "Must", ["requirement"])], "id string, type string, title string, labels array<string>")
    edges = spark.createDataFrame([("1", "depends_on", "a", "b", True), ("2", "depends_on", "c", "a", True)], "id string, relationship_type string, source_id string, target_id string, directed boolean")
    g = Graph(nodes, edges)
    ids = lambda df: [r.id for r in df.orderBy("id").collect()]
    assert ids(g.query(node_type="decision")[0]) == ["a"] and ids(g.query(tags=("db",))[0]) == ["a", "b"]
    assert [ids(x) for x in g.query(edge_type="depends_on")] == [[], ["1", "2"]] and ids(g.query()[0]) == ["a", "b", "c"]
    assert g.shortest_path("c", "b") == ["c", "a", "b"] and ids(g.descendants("c")) == ["a", "b"] and ids(g.ancestors("b", 1)) == ["a"] and ids(g.neighborhood("a")) == ["b", "c"] and ids(g.neighbors("a", "incoming")) == ["c"]
    assert g.has_path("c", "b") and not g.has_path("b", "c") and g.connected_components().select("component").distinct().count() == 1
    assert g.traverse("c", "bfs", max_depth=1).count() == 2 and g.validate().count() == 0 and g.statistics()["edge_count"] == 2
    assert g.save(f"file://{tmp_path}/g", "knowledge") == ["graph_nodes.jsonl", "graph_edges.jsonl"]
    g.save(f"file://{tmp_path}/g", "graph")
    back = Graph.load(spark, f"file://{tmp_path}/g/graph.jsonl", "id string, type string", "id string, relationship_type string, source_id string, target_id string, directed boolean")
    assert ids(back.nodes) == ["a", "b", "c"] and back.edges.count() == 2
    k = Knowledge(spark)
    k.register_types(spark.createDataFrame([("own", "Own", "x", None), ("risk", "Other", "y", None)], schemas.KNOWLEDGE_TYPES))
    assert k.types.filter("id IN ('own', 'risk')").count() == 2 and k.types.filter("name = 'Other'").count() == 1


def test_large_files_are_hashed_and_unread_text_is_reported(spark, tmp_path):
    with open(tmp_path / "big.txt", "wb") as f:
        f.write(b"text" * 300)
        f.truncate(100_000_001)
    (tmp_path / "small.txt").write_text("text")
    options = load(tmp_path).discovery
    files = tree.scan(spark, str(tmp_path))
    hashes = {r.relative_path: r.hash for r in tree.read_files(files, options["hash_algorithm"], options["max_file_size"]).collect()}
    assert set(hashes) == {"big.txt", "small.txt"} and all(hashes.values())
    got = {r.relative_path: (r.text, r.failed) for r in tree.read_files(files, max_bytes=1000, content=True).collect()}
    assert got["small.txt"] == ("text", None) and got["big.txt"][0] is None and "above the limit" in got["big.txt"][1]
