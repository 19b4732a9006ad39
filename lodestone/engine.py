"""The engine: from a directory to an inventory, to knowledge objects, to a graph, to files."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.config import Config, load
from lodestone.functions import paths
from lodestone.functions.text import diagnostic_line
from lodestone.operators import discovery, extract, graph, knowledge, markdown, pycode, segments, structure
from lodestone.operators.lookup import type_registry
from lodestone.plugins import Registry
from lodestone.session import cut
from lodestone.sources import tree
from lodestone.sources.workspace import Workspace, now
from lodestone.streaming.events import DiscoveryCompleted, EventBus

OUTPUTS = (
    "index/source_catalog.jsonl knowledge/catalog.jsonl graph/graph.jsonl knowledge/graph_nodes.jsonl knowledge/graph_edges.jsonl graph/graph.dot graph/graph.cypher reports/summary.md reports/summary.json logs/analysis.log"
).split()
REGISTRY = "relative_path string, absolute_path string, id string, type string, category string, extension string, hash string, size bigint, modified_time timestamp, created_time timestamp, parent_directory string, is_directory boolean, scan_seq bigint"


@dataclass
class Discovery:
    artifacts: DataFrame
    changes: DataFrame
    tallies: dict = field(default_factory=dict)


@dataclass
class Analysis:
    artifacts: DataFrame
    objects: DataFrame
    relationships: DataFrame
    nodes: DataFrame
    edges: DataFrame
    diagnostics: DataFrame
    statistics: dict

    @property
    def ok(self) -> bool:
        return knowledge.ok(self.diagnostics)


class Engine:
    def __init__(self, spark: SparkSession, config: Config | None = None, registry: Registry | None = None, bus: EventBus | None = None):
        self.spark, self.config, self.registry, self.bus = spark, config, registry or Registry(), bus or EventBus()

    def workspace(self, root: str | Path) -> Workspace:
        return Workspace(Path(root) / self._config(root).workspace_dir, self.bus)

    def _config(self, root: str | Path) -> Config:
        return self.config or load(root)

    # ---- discovery ---------------------------------------------------------------------------------------------------

    def discover(self, root: str | Path, save: bool = True) -> Discovery:
        """The inventory of ``root``, with the hash of every file and the changes since the last saved one.

        Only files whose size or time changed are opened. Binary files that are not media, archives or office files are left out,
        as are ignored names; user rules come from .lodestoneignore, then from the configuration.
        """
        root, config = Path(root).resolve(), self._config(root)
        options = config.discovery
        ignore = root / ".lodestoneignore"
        lines = (ignore.read_text("utf-8").splitlines() if ignore.exists() else []) + list(options["ignore_patterns"])
        found = tree.scan(self.spark, str(root), ignore=lines, follow_symlinks=options["follow_symlinks"], include_directories=options["include_directories"])
        previous = self._registry(root)
        marked = cut(discovery.with_hash(discovery.classify(found.drop("content")), previous))  # the tree is walked once
        read = tree.read_files(marked.filter("need_hash AND NOT is_directory"), options["hash_algorithm"], options["max_file_size"])
        hashed = read.select("relative_path", F.col("hash").alias("__new"), "binary")
        opaque = F.col("category").isin("media", "archive") | F.col("type").isin("pdf", "docx", "pptx")
        full = marked.join(hashed, "relative_path", "left").filter(~F.coalesce("binary", F.lit(False)) | opaque)
        names = [c.split()[0] for c in REGISTRY.split(", ")]
        artifacts = cut(full.withColumn("hash", F.coalesce("hash", "__new")).select(*names))
        changes = discovery.snapshot_diff(previous, artifacts)
        tallies = {r.status: r.n for r in discovery.change_tallies(changes).collect()}
        if save:
            space = self.workspace(root)
            if not space.exists():
                space.init(root.name)
            artifacts.write.mode("overwrite").parquet(f"file://{space.path('index/registry.parquet')}")
        self.bus.publish(DiscoveryCompleted(added=tallies.get("new", 0), modified=tallies.get("modified", 0), deleted=tallies.get("deleted", 0), renamed=tallies.get("renamed", 0)))
        return Discovery(artifacts, changes, tallies)

    def _registry(self, root: Path) -> DataFrame:
        """The saved inventory, as it is now: it is read before it is replaced. Empty if there is none."""
        path = self.workspace(root).root / "index/registry.parquet"
        if not path.exists():
            return self.spark.createDataFrame([], REGISTRY)
        return cut(self.spark.read.schema(REGISTRY).parquet(f"file://{path}"))

    # ---- extraction --------------------------------------------------------------------------------------------------

    def extract(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(candidates, diagnostics) of ``docs`` (source_uri, content, mime_type): Markdown, other text, JSON and YAML, each by its reader.

        A reader plugin's segments come first. What no reader takes is a diagnostic.
        """
        mime = F.col("mime_type")
        kind = F.when(mime.isin("text/markdown", "text/x-markdown"), "markdown").when(mime.startswith("text/"), "text").when(mime.rlike("json|yaml"), "structured").when(mime.rlike("^(image|audio|video)/|octet-stream"), "binary")
        foreign = self.registry.resolve("reader")  # callables with ``mime_types``, from docs to elements; they come before the engine's own
        for reader in reversed(foreign):
            kind = F.when(mime.isin(list(reader.mime_types)), f"plugin:{foreign.index(reader)}").otherwise(kind)
        docs = docs.withColumn("reader", kind)
        elements = markdown.elements(docs.filter("reader = 'markdown'"))
        for i, reader in enumerate(foreign):
            elements = elements.unionByName(reader(docs.filter(F.col("reader") == f"plugin:{i}").drop("reader")), allowMissingColumns=True)
        gate = knowledge.check_elements(elements)
        bad = gate.filter("level = 'error'").select(F.col("source_ref").alias("source_uri")).distinct()
        trees = elements.join(bad, "source_uri", "left_anti")
        structured = structure.structure(docs.filter("reader = 'structured'"))
        parts = [
            markdown.element_segments(trees).withColumn("stage", F.lit(10)),
            segments.text_segments(docs.filter("reader = 'text'")),
            structured.filter("error IS NULL").select(*segments.COLUMNS).withColumn("stage", F.lit(20)),
            *(s(docs).select(*segments.COLUMNS).withColumn("stage", F.lit(100 + i)) for i, s in enumerate(self.registry.resolve("segmenter"))),
        ]
        every = reduce(DataFrame.unionByName, parts)
        found = reduce(DataFrame.unionByName, [x(every) for x in (*self.registry.resolve("extractor"), extract.candidates)])
        checked = cut(extract.check_candidates(found, [r.id for r in self.types("knowledge").select("id").collect()]).join(docs.select("source_uri", "mime_type"), "source_uri"))
        for validator in self.registry.resolve("candidate_validator"):
            checked = validator(checked)
        error = lambda df, code, message: df.select(F.lit("error").alias("level"), F.lit(code).alias("code"), message.alias("message"), F.col("source_uri").alias("source_ref"))
        diagnostics = [
            gate,
            error(elements.filter("error IS NOT NULL"), "extraction_failed", F.col("error")),
            error(structured.filter("error IS NOT NULL"), "extraction_failed", F.col("error")),
            error(checked.filter("failed IS NOT NULL"), "candidate_validation_failed", F.col("failed")),
            error(docs.filter("reader IS NULL"), "unsupported_mime_type", F.concat(F.lit("no reader for "), "mime_type")),
        ]
        return checked, reduce(DataFrame.unionByName, diagnostics)

    # ---- analysis ----------------------------------------------------------------------------------------------------

    def analyze(self, root: str | Path, force: bool = False, persist: bool = True) -> Analysis:
        """Discover, extract, build the graph, validate and write the workspace's files."""
        root = Path(root).resolve()
        space = self.workspace(root)
        if force and space.exists():
            space.init(root.name, force=True)
        artifacts = self.discover(root).artifacts
        project = self._config(root).project_name or root.name
        files = cut(extract.file_objects(artifacts, project))
        read = cut(tree.read_files(artifacts.join(files.select("relative_path"), "relative_path", "left_semi"), content=True))
        failed = read.filter("failed IS NOT NULL").select(F.lit("error").alias("level"), F.lit("read_failed").alias("code"), F.col("failed").alias("message"), F.col("relative_path").alias("source_ref"))
        skipped = artifacts.filter("NOT is_directory").join(files.select("relative_path"), "relative_path", "left_anti").select(F.lit("info").alias("level"), F.lit("skipped_artifact").alias("code"), F.concat(F.lit("no text in files of type "), "type").alias("message"), F.col("relative_path").alias("source_ref"))
        texts = read.filter("text IS NOT NULL").select("relative_path", F.col("text").alias("content"))
        python = texts.filter(paths.suffix_of(F.col("relative_path")) == ".py")
        others = texts.filter(paths.suffix_of(F.col("relative_path")) != ".py").select(F.col("relative_path").alias("source_uri"), "content", paths.mime_of(F.col("relative_path")).alias("mime_type"))
        parsed = cut(pycode.parse_components(python))
        broken = parsed.filter("error IS NOT NULL").select(F.lit("error").alias("level"), F.lit("python_parse_failed").alias("code"), F.col("error").alias("message"), F.col("relative_path").alias("source_ref"))
        code = pycode.first_of_each(parsed)
        checked, reports = self.extract(others)
        found = self.registry.first("candidate_builder", extract.objects)(checked, project)
        shape = lambda df, uri, custom="map()": df.select("id", "type", "title", "description", "content", F.col(uri).alias("source_uri"), F.lit(1.0).alias("confidence"), F.lit(project).alias("project_id"), F.expr(custom).cast("map<string,string>").alias("metadata"))
        named = "map_filter(map('language', 'python', 'name', regexp_extract(id, '[^/.]+$', 0), 'full_name', if(id LIKE '%/func/%', substring_index(id, '/', -1), null)), (k, v) -> v IS NOT NULL)"
        inner = shape(code.withColumns({"type": F.lit("component"), "description": F.col("title")}), "relative_path", named).unionByName(shape(found, "source_uri"))
        inner = cut(inner)
        # files that hold nothing and are no targets stay out of the graph
        holders = files.join(inner.select(F.col("source_uri").alias("relative_path")).distinct(), "relative_path", "left_semi")
        outer = shape(holders.select("id", F.col("object_type").alias("type"), "title", "description", F.lit(None).cast("string").alias("content"), "relative_path", "category"), "relative_path", "map('relative_path', relative_path, 'category', category)")
        objects = cut(outer.unionByName(inner))
        links = extract.contains(holders, inner).select("id", "relationship_type", "source_id", "target_id")
        imports = extract.resolve_imports(pycode.parse_imports(python), artifacts, holders)
        depends = imports.select(F.concat(F.lit("depends_on:"), "source_id", F.lit("->"), "target_id").alias("id"), F.lit("depends_on").alias("relationship_type"), "source_id", "target_id")
        relationships = cut(links.unionByName(depends))
        nodes = objects.select("id", F.col("id").alias("object_id"), "type", "title", F.array("type").alias("labels"), F.struct("type", F.lit(None).cast("string").alias("domain"), "project_id", F.lit("draft").alias("lifecycle"), "confidence", F.col("source_uri").alias("source"), F.array().cast("array<string>").alias("tags"), "title", "description").alias("properties"), "metadata")
        edges = relationships.withColumns({"directed": ~F.col("relationship_type").isin(list(schemas.UNDIRECTED)), "relationship_id": F.col("id")})
        nodes, edges = cut(nodes), cut(edges)
        checks = [graph.validate(nodes, edges, self.types("relationship"))]
        checks += [validator(objects) for provider in self.registry.resolve("knowledge_validator_provider") for validator in provider()]
        diagnostics = cut(reduce(DataFrame.unionByName, [skipped, failed, broken, reports, *checks]))
        result = Analysis(artifacts, objects, relationships, nodes, edges, diagnostics, graph.statistics(nodes, edges))
        if persist:
            self.persist(root, result)
        return result

    def persist(self, root: str | Path, a: Analysis) -> None:
        """The workspace's files. Lines are streamed through the driver, a partition at a time."""
        root, space = Path(root).resolve(), self.workspace(root)
        stream = lambda df: (r[0] for r in df.toLocalIterator())
        record = lambda df, kind: df.select(F.to_json(F.struct(F.lit(kind).alias("kind"), F.struct(*df.columns).alias("data"))).alias("line"))
        space.write_lines("index/source_catalog.jsonl", stream(record(a.artifacts.orderBy("relative_path"), "ArtifactEntry")))
        types = self.types("knowledge"), self.types("relationship")
        evidence = self.spark.createDataFrame([(e, e.replace("_", " ").title()) for e in schemas.EVIDENCE_TYPES], "id string, name string")
        about = self.spark.createDataFrame([(root.name, now())], "project string, generated_at string")
        catalog = [record(types[0], "KnowledgeType"), record(types[1], "RelationshipType"), record(evidence, "EvidenceType"), record(a.objects.orderBy("id"), "KnowledgeObject"), record(a.relationships.orderBy("id"), "KnowledgeRelationship"), record(about, "metadata")]
        space.write_lines("knowledge/catalog.jsonl", (x for df in catalog for x in stream(df)))
        storage = self.registry.last("graph_storage")
        if storage:
            storage.save(a.nodes, a.edges, str(space.root))
        for name in () if storage else ("graph/graph.jsonl", "knowledge/graph_nodes.jsonl", "knowledge/graph_edges.jsonl", "graph/graph.dot", "graph/graph.cypher"):
            space.write_lines(name, stream(self.graph_lines(a.nodes, a.edges, name)))
        counts = a.statistics
        diagnostics = [r.asDict() for r in a.diagnostics.orderBy("level", "code", "source_ref").collect()]
        summary = {
            "ok": not any(d["level"] == "error" for d in diagnostics), "project_root": str(root), "artifact_count": a.artifacts.count(), "object_count": counts["node_count"], "relationship_count": counts["edge_count"],
            "graph_density": counts["density"], "node_type_counts": counts["node_type_counts"], "edge_type_counts": counts["edge_type_counts"], "diagnostics": diagnostics,
        }
        space.write_json("reports/summary.json", summary)
        lines = ["# Analysis summary", "", f"- Project: {root.name}", f"- Artifacts: {summary['artifact_count']}", f"- Objects: {summary['object_count']}", f"- Relationships: {summary['relationship_count']}", f"- Graph density: {counts['density']:.4f}"]
        for title, key in (("Node types", "node_type_counts"), ("Edge types", "edge_type_counts")):
            if counts[key]:
                lines += ["", f"## {title}", *(f"- {k}: {v}" for k, v in sorted(counts[key].items()))]
        space.write_lines("reports/summary.md", lines)
        log = a.diagnostics.select(F.concat(diagnostic_line(F.col("level"), F.col("code"), F.col("message")), F.coalesce(F.concat(F.lit("\n  source: "), "source_ref"), F.lit(""))))
        space.write_lines("logs/analysis.log", stream(log))
        manifest = space.read_json("workspace.json")
        space.write_json("workspace.json", manifest | {"updated_at": now(), "artifacts": list(OUTPUTS)})

    @staticmethod
    def graph_lines(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
        """Lines of one of the graph's text forms, in order, by the name of the file."""
        if name.endswith(".dot"):
            return graph.dot_lines(nodes, edges).orderBy("part", "line").select("line")
        if name.endswith(".cypher"):
            return graph.cypher_lines(nodes, edges).orderBy("part", "line").select("line")
        lines = graph.jsonl_lines(nodes, edges)
        keep = {"graph_nodes.jsonl": "part = 1", "graph_edges.jsonl": "part = 2"}.get(name.rpartition("/")[2], "true")
        return lines.filter(keep).orderBy("part", "line").select("line")

    def types(self, what: str) -> DataFrame:
        """The dimension of knowledge or relationship types, with those of plugins, whose providers return a DataFrame of the same columns."""
        rows = {"knowledge": knowledge.knowledge_types, "relationship": knowledge.relationship_types}[what](self.spark)
        for provider in self.registry.resolve(f"{what}_type_provider"):
            rows = type_registry(rows, provider(self.spark))
        return rows

    # ---- the graph's own interface -------------------------------------------------------------------------------------

    def query(self, q: graph.GraphQuery, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(node ids, edge ids) in ascending order."""
        run = self.registry.last("graph_query_engine")
        if run:
            return run(q, nodes, edges)
        return graph.query_nodes(q, nodes, edges).orderBy("id"), graph.query_edges(q, edges).orderBy("id")

    def traverse(self, t: graph.Traversal, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        return self.registry.last("graph_traversal", graph.traverse)(t, nodes, edges)

    def load_graph(self, root: str | Path) -> tuple[DataFrame, DataFrame]:
        from lodestone.sources.catalog import graph_from_jsonl

        nodes = "id string, object_id string, type string, title string, labels array<string>, properties struct<type: string, domain: string, project_id: string, lifecycle: string, confidence: double, source: string, tags: array<string>, title: string, description: string>, metadata map<string, string>"
        edges = "id string, relationship_type string, source_id string, target_id string, directed boolean, relationship_id string"
        return graph_from_jsonl(self.spark, f"file://{self.workspace(root).path('graph/graph.jsonl')}", nodes, edges)
