"""Graphs as text: Mermaid, chains, impact reports, and a self-contained page.

Rendering is for graphs that people look at; rows are computed on executors and come to the driver in order.
"""

from __future__ import annotations

import html
import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.ids import display_name, mermaid_id
from weft.operators.assets import asset_graph
from weft.operators.model import ASSET_TYPES, Graph
from weft.operators.traverse import impact_summary, root_paths
from weft.operators.views import suffixed_ids
from weft.session import cut
from weft.sources.store import json_rows, write_text

#: Chains that are printed at most; fixed value.
CHAINS = 80


def mermaid_nodes(nodes: DataFrame) -> DataFrame:
    """(id, shown, label): unique safe ids and escaped labels."""
    shown = suffixed_ids(nodes, mermaid_id(F.col("id")))
    label = F.regexp_replace(F.translate(display_name(F.col("name"), F.col("type")), '"', "'"), r"[\r\n]+", " ")
    return nodes.select("id", label.alias("label")).join(shown, "id")


def render_mermaid(graph: Graph) -> str:
    names = cut(mermaid_nodes(graph.nodes))
    lines = ["graph LR"]
    lines += [f'    {r["shown"]}["{r["label"]}"]' for r in names.orderBy("id").toLocalIterator()]
    ends = lambda c: names.select(F.col("id").alias(c), F.col("shown").alias(c + "_shown"))
    edges = graph.edges.join(ends("source"), "source").join(ends("target"), "target").select("source", "target", "type", "source_shown", "target_shown").distinct()
    lines += [f'    {r["source_shown"]} --> {r["target_shown"]}' for r in edges.orderBy("source", "target", "type").toLocalIterator()]
    return "\n".join(lines) + "\n"


def chains(graph: Graph, limit: int | None = CHAINS) -> DataFrame:
    """(position, chain): root-to-sink paths by their display names, one under the other, in the order of ``root_paths``."""
    from pyspark.sql import Window

    order = Window.orderBy(F.col("out").desc(), "path")  # of at most ``limit`` paths
    paths = root_paths(graph.nodes, graph.edges, limit).withColumn("position", F.row_number().over(order))
    steps = paths.select("position", F.posexplode("path").alias("k", "id")).join(graph.nodes.select("id", display_name(F.col("name"), F.col("type")).alias("label")), "id", "left")
    texts = steps.groupBy("position").agg(F.array_sort(F.collect_list(F.struct("k", F.coalesce("label", "id").alias("label")))).alias("s"))
    return texts.select("position", F.array_join(F.transform("s", lambda x: x["label"]), "\n   ↓\n").alias("chain"))


def format_chains(graph: Graph) -> str:
    if graph.nodes.isEmpty():
        return "Graph is empty.\n"
    return "\n\n".join(r["chain"] for r in chains(graph).orderBy("position").toLocalIterator()) + "\n"


def impact_document(impacted: DataFrame, query: str, resolved: str) -> dict[str, Any]:
    """The impact as the command line prints it: direct has depth 1, downstream more."""
    counts = impact_summary(impacted).first()
    rows = [r.asDict() for r in impacted.orderBy("depth", "id").toLocalIterator()]
    return {
        "query": query, "resolved_id": resolved, "direct": [r for r in rows if r["depth"] == 1], "downstream": [r for r in rows if r["depth"] > 1],
        "affected_count": counts["affected"],
    }


def shown_name(node: dict[str, Any]) -> str:
    """``display_name`` of one node."""
    name = node["name"] or node["id"]
    return name + "()" if node["type"] == "python_function" and not name.endswith("()") else name


def impact_text(document: dict[str, Any], origin: dict[str, Any]) -> str:
    show = lambda rows: "\n".join(f"  → {shown_name(r)}" for r in rows) or "  (none)"
    return f"Impact: {shown_name(origin)}\n\nDirect:\n{show(document['direct'])}\n\nDownstream:\n{show(document['downstream'])}\n"


def viewer_payload(graph: Graph, excerpts: DataFrame | None = None) -> dict[str, Any]:
    """What the page needs: nodes with labels, edges, the asset view, and excerpts if they are wanted."""
    view = asset_graph(graph)
    lines = lambda rows: [json.loads(r["line"]) for r in rows.toLocalIterator()]
    nodes, edges = (lines(r) for r in json_rows(graph))
    for n in nodes:
        n["label"] = shown_name(n)
    payload: dict[str, Any] = {
        "nodes": nodes, "edges": edges, "asset_types": sorted(ASSET_TYPES), "asset_edges": lines(json_rows(view)[1]), "includes_source": excerpts is not None,
    }
    if excerpts is not None:
        payload["excerpts"] = [r.asDict() for r in excerpts.toLocalIterator()]
    return payload


def embed_json(payload: Any) -> str:
    """JSON that can stand in a script element."""
    text = json.dumps(payload, ensure_ascii=False, sort_keys=True)
    for c in "<>&  ":
        text = text.replace(c, f"\\u{ord(c):04x}")
    return text


#: The page: filters by mode, type, namespace and component, search, highlights, and an inspector of nodes and edges.
_PAGE = Path(__file__).with_name("viewer.html")


def render_html(payload: dict[str, Any], title: str = "Lineage") -> str:
    """One page without outside resources."""
    head, rest = _PAGE.read_text(encoding="utf-8").split("__TITLE__", 1)
    middle, tail = rest.split("__PAYLOAD__", 1)
    return head + html.escape(title) + middle + embed_json(payload) + tail


def write_html(path: str, payload: dict[str, Any], title: str = "Lineage") -> str:
    return write_text(path, render_html(payload, title))
