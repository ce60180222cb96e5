"""Graphs on disk: Parquet as the native form, canonical JSON for exchange."""

from __future__ import annotations

import json
import os
import tempfile
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.errors import GraphNotFound, StoreError
from weft.operators.model import CONFIDENCE, EDGE_SCHEMA, NODE_SCHEMA, Graph

SCHEMA_VERSION = "0.1"


def utc_now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def save_parquet(graph: Graph, folder: str) -> None:
    """Nodes and edges below ``folder``, clustered by the keys that they are joined on."""
    graph.nodes.sortWithinPartitions("id").write.mode("overwrite").parquet(f"{folder}/nodes")
    graph.edges.repartition("source").sortWithinPartitions("source", "target").write.mode("overwrite").parquet(f"{folder}/edges")


def load_parquet(spark: SparkSession, folder: str) -> Graph:
    return Graph(spark.read.schema(NODE_SCHEMA).parquet(f"{folder}/nodes"), spark.read.schema(EDGE_SCHEMA).parquet(f"{folder}/edges"))


def json_rows(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """(line) of nodes by id and of edges by source, target and type, each one canonical JSON object.

    Metadata values are spliced in as the JSON they are, by key; a distributed export writes these lines.
    """
    body = lambda: F.concat(
        F.lit("{"), F.coalesce(F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(_quoted(e["key"]), F.lit(":"), F.coalesce(e["value"], F.lit("null")))), ","), F.lit("")), F.lit("}")
    )
    either = lambda c: F.coalesce(_quoted(F.col(c)), F.lit("null"))
    node = F.concat(
        F.lit('{"id":'), either("id"), F.lit(',"name":'), either("name"), F.lit(',"type":'), either("type"), F.lit(',"file_path":'), either("file_path"),
        F.lit(',"line_number":'), F.coalesce(F.col("line_number").cast("string"), F.lit("null")), F.lit(',"metadata":'), body(), F.lit("}"),
    )
    words = F.element_at(F.array(*(F.lit(w) for w in CONFIDENCE)), F.coalesce("confidence", F.lit(0)).cast("int") + 1)
    evidence = F.when(F.size("evidence") > 0, _quoted(F.array_join("evidence", "|"))).otherwise(F.lit("null"))
    edge = F.concat(
        F.lit('{"source":'), either("source"), F.lit(',"target":'), either("target"), F.lit(',"type":'), either("type"), F.lit(',"confidence":'), _quoted(words),
        F.lit(',"evidence":'), evidence, F.lit(',"metadata":'), body(), F.lit("}"),
    )
    return graph.nodes.orderBy("id").select(node.alias("line")), graph.edges.orderBy("source", "target", "type").select(edge.alias("line"))


def _quoted(column: Any) -> Any:
    """A text as a JSON text."""
    return F.when(column.isNotNull(), F.regexp_extract(F.to_json(F.struct(column.alias("v"))), r'^\{"v":([\s\S]*)\}$', 1))


def _canonical(value: Any) -> Any:
    if isinstance(value, dict):
        return {k: _canonical(value[k]) for k in sorted(value)}
    return [_canonical(v) for v in value] if isinstance(value, list) else value


def graph_document(graph: Graph, *, name: str, path: str, timestamp: str | None = None, files_scanned: int = 0, warnings: list[str] = ()) -> dict:
    """The whole graph as one JSON document; for graphs of a repository, which fit the driver as the artifact does."""
    nodes, edges = ([json.loads(r["line"]) for r in rows.toLocalIterator()] for rows in json_rows(graph))
    for item in (*nodes, *edges):
        item["metadata"] = _canonical(item["metadata"])
    return {
        "version": SCHEMA_VERSION, "project": {"name": name, "path": path}, "nodes": nodes, "edges": edges,
        "scan": {"timestamp": timestamp or utc_now(), "files_scanned": files_scanned, "warnings": list(warnings)},
    }


def render_json(document: dict) -> str:
    return json.dumps(document, ensure_ascii=False, indent=2) + "\n"


def write_text(path: str, text: str) -> str:
    """Writes a file in one step: a temporary one beside it is flushed and moved there, or removed on failure."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=folder, prefix=".weft-")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    except BaseException:
        if os.path.exists(temporary):
            os.unlink(temporary)
        raise
    return path


def load_document(path: str) -> dict:
    if not os.path.exists(path):
        raise GraphNotFound(f"no graph at {path}; run a scan first")
    try:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        if not isinstance(data, dict) or not isinstance(data.get("nodes"), list) or not isinstance(data.get("edges"), list):
            raise ValueError("nodes and edges are missing")
    except ValueError as e:
        raise StoreError(f"unable to read {path}: {e}") from e
    return data


def load_graph(spark: SparkSession, path: str) -> Graph:
    """The graph of a JSON document as DataFrames; a missing file or a broken document is an error."""
    data = load_document(path)
    flat = lambda m: {k: json.dumps(v, ensure_ascii=False) for k, v in (m or {}).items()}
    try:
        nodes = [(n["id"], n["name"], n["type"], n.get("file_path"), n.get("line_number"), flat(n.get("metadata"))) for n in data["nodes"]]
        edges = [
            (e["source"], e["target"], e["type"], CONFIDENCE.index(e.get("confidence") or "low"), e["evidence"].split("|") if e.get("evidence") else [], flat(e.get("metadata")))
            for e in data["edges"]
        ]
    except (KeyError, TypeError, ValueError, AttributeError) as e:
        raise StoreError(f"unable to read {path}: {e}") from e
    return Graph(spark.createDataFrame(nodes, NODE_SCHEMA), spark.createDataFrame(edges, EDGE_SCHEMA))
