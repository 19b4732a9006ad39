"""Objects over the operators, for those who prefer methods: a graph, and the knowledge rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lodestone.operators import graph as G
from lodestone.operators import knowledge as K
from lodestone.sources import catalog


@dataclass(frozen=True)
class Graph:
    """Two DataFrames and what can be asked of them. Nothing is computed before a result is."""

    nodes: DataFrame
    edges: DataFrame

    @classmethod
    def build(cls, objects: DataFrame, relationships: DataFrame, relationship_types: DataFrame | None = None) -> Graph:
        known = K.relationship_types(objects.sparkSession)
        return cls(*G.build(objects, relationships, relationship_types if relationship_types is not None else known, known))

    @classmethod
    def load(cls, spark: SparkSession, path: str, nodes: str, edges: str) -> Graph:
        """From what save() wrote as graph.jsonl; the schemas are DDL texts."""
        return cls(*catalog.graph_from_jsonl(spark, path, nodes, edges))

    def save(self, folder: str, profile: str = "all") -> list[str]:
        return catalog.save_graph(self.nodes, self.edges, folder, profile)

    def query(self, **criteria) -> tuple[DataFrame, DataFrame]:
        """(node ids, edge ids), ascending, for the criteria of GraphQuery."""
        q = G.GraphQuery(**criteria)
        return G.query_nodes(q, self.nodes, self.edges).orderBy("id"), G.query_edges(q, self.edges).orderBy("id")

    def traverse(self, start: str, strategy: str = "bfs", **options) -> DataFrame:
        return G.traverse(G.Traversal(start, strategy, **options), self.nodes, self.edges)

    def neighbors(self, node: str, direction: str = "both", edge_types: list[str] | None = None) -> DataFrame:
        return G.neighbors(self.edges, node, direction, edge_types)

    def descendants(self, node: str, max_depth: int | None = None) -> DataFrame:
        return G.descendants(self.nodes, self.edges, node, max_depth)

    def ancestors(self, node: str, max_depth: int | None = None) -> DataFrame:
        return G.ancestors(self.nodes, self.edges, node, max_depth)

    def neighborhood(self, node: str, radius: int = 1) -> DataFrame:
        return G.neighborhood(self.nodes, self.edges, node, radius)

    def connected_components(self) -> DataFrame:
        return G.components(self.nodes, self.edges)

    def has_path(self, start: str, end: str) -> bool:
        return G.has_path(self.nodes, self.edges, start, end)

    def shortest_path(self, start: str, end: str) -> list[str]:
        return G.shortest_path(self.nodes, self.edges, start, end)

    def statistics(self) -> dict:
        return G.statistics(self.nodes, self.edges)

    def validate(self, relationship_types: DataFrame | None = None) -> DataFrame:
        return G.validate(self.nodes, self.edges, relationship_types if relationship_types is not None else K.relationship_types(self.nodes.sparkSession))


class Knowledge:
    """Types and rules of knowledge objects; rules may be added, types registered, later ones in place of earlier ones."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.types, self.relationship_types, self.rules = K.knowledge_types(spark), K.relationship_types(spark), []

    def register_types(self, rows: DataFrame) -> None:
        from lodestone.operators.lookup import type_registry

        self.types = type_registry(self.types, rows)

    def register_relationship_types(self, rows: DataFrame) -> None:
        from lodestone.operators.lookup import type_registry

        self.relationship_types = type_registry(self.relationship_types, rows)

    def add_rule(self, rule) -> None:
        """``rule``: a function from objects to diagnostics."""
        self.rules.append(rule)

    def validate(self, objects: DataFrame, relationships: DataFrame) -> DataFrame:
        return K.validate_catalog(objects, relationships, self.types, self.relationship_types, self.rules)
