"""The library's front: scanning a repository and asking its graph."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import assets, identity, render, resolve, scope, traverse, views
from weft.operators.model import Graph, build_graph
from weft.session import cut
from weft.sources import store
from weft.sources.repository import Config, extract_facts, fact_edges, fact_nodes, load_config, repository_files


@dataclass
class LineageGraph:
    """A graph with the questions that can be asked of it; nodes are named as ``resolve`` understands."""

    spark: SparkSession
    graph: Graph
    name: str = ""
    path: str = ""
    files_scanned: int = 0
    warnings: list[str] = field(default_factory=list)

    @property
    def nodes(self) -> DataFrame:
        return self.graph.nodes

    @property
    def edges(self) -> DataFrame:
        return self.graph.edges

    def resolve(self, query: str) -> str:
        return resolve.resolve(self.nodes, query)

    def node(self, node_id: str) -> dict:
        """Id, name, type and file of one node."""
        row = self.nodes.filter(F.col("id") == node_id).select(*resolve.SHOWN).first()
        return row.asDict() if row else {}

    def impact(self, query: str, max_depth: int | None = None) -> DataFrame:
        return traverse.impact(self.nodes, self.edges, self.resolve(query), max_depth)

    def downstream(self, query: str) -> DataFrame:
        return traverse.neighbours(self.edges, self.resolve(query))

    def upstream(self, query: str) -> DataFrame:
        return traverse.neighbours(self.edges, self.resolve(query), forward=False)

    def _closure(self, query: str, forward: bool) -> DataFrame:
        start = self.spark.createDataFrame([(self.resolve(query),)], "id string")
        return traverse.walk(self.edges, start, forward=forward).select("id", "depth")

    def descendants(self, query: str) -> DataFrame:
        return self._closure(query, True)

    def ancestors(self, query: str) -> DataFrame:
        return self._closure(query, False)

    def with_graph(self, graph: Graph) -> LineageGraph:
        return LineageGraph(self.spark, graph, self.name, self.path, self.files_scanned, self.warnings)

    def scoped(self) -> LineageGraph:
        return self.with_graph(scope.lineage_scope(self.graph))

    def identified(self) -> LineageGraph:
        return self.with_graph(identity.resolve_identity(self.graph))

    def assets(self) -> LineageGraph:
        return self.with_graph(assets.asset_graph(self.graph))

    def components(self) -> DataFrame:
        return traverse.components(self.nodes, self.edges)

    def layers(self) -> DataFrame:
        return traverse.layers(self.nodes, self.edges)

    def search(self, text: str) -> Graph:
        return views.search(self.graph, text)

    def register_views(self, prefix: str = "lineage") -> None:
        """``<prefix>_nodes`` and ``<prefix>_edges`` for Spark SQL."""
        self.nodes.createOrReplaceTempView(f"{prefix}_nodes")
        self.edges.createOrReplaceTempView(f"{prefix}_edges")

    def document(self) -> dict:
        return store.graph_document(self.graph, name=self.name, path=self.path, files_scanned=self.files_scanned, warnings=self.warnings)

    def to_json(self) -> str:
        return store.render_json(self.document())

    def to_mermaid(self) -> str:
        return render.render_mermaid(self.graph)

    def to_chains(self) -> str:
        return render.format_chains(self.graph)

    def to_html(self, path: str) -> str:
        return render.write_html(path, render.viewer_payload(self.graph), self.name or "Lineage")


class Engine:
    """Scans repositories and loads stored graphs."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def scan(self, root: str, *, config: Config | None = None, scoped: bool = True) -> LineageGraph:
        """The graph of a repository: facts of all files, merged, identified and, unless switched off, scoped.

        Dangling edges go before datasets are identified, and those before the scope is drawn.
        """
        config = config or load_config(root)
        files = cut(repository_files(self.spark, root, config))
        facts = cut(extract_facts(files))
        graph, dangling = build_graph(fact_nodes(facts), fact_edges(facts))
        graph = Graph(cut(graph.nodes), cut(graph.edges))
        messages = [r[0] for r in files.filter("warning is not null").select("warning").orderBy("path").toLocalIterator()]
        messages += [r[0] for r in facts.filter("kind = 'warning'").orderBy("file", "parser", "seq").select("message").toLocalIterator()]
        messages += [r[0] for r in dangling.orderBy("message").toLocalIterator()]
        graph = identity.resolve_identity(graph)
        graph = Graph(cut(graph.nodes), cut(graph.edges))
        if scoped:
            graph = scope.lineage_scope(graph)
        count = files.filter(F.col("content").isNotNull()).count()
        return LineageGraph(self.spark, graph, os.path.basename(os.path.abspath(root)), root, count, [*config.warnings, *messages])

    def load(self, path: str) -> LineageGraph:
        """A stored JSON document or Parquet folder."""
        if os.path.isdir(path):
            return LineageGraph(self.spark, store.load_parquet(self.spark, path))
        data = store.load_document(path)
        project, scan = data.get("project") or {}, data.get("scan") or {}
        return LineageGraph(self.spark, store.load_graph(self.spark, path), project.get("name", ""), project.get("path", ""), scan.get("files_scanned", 0), scan.get("warnings", []))
