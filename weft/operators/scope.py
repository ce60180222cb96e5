"""The lineage scope: anchors, what touches them, and the flows between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.model import Graph, induced, is_anchor, is_bridge, is_code
from weft.operators.traverse import BACKWARD, COMPACT, arcs
from weft.session import cut, cut_observed


def _extend(links: DataFrame, seen: DataFrame | None, more: DataFrame) -> DataFrame:
    """``seen`` with ``more`` and all that it reaches; only new nodes are walked from."""
    frontier, new = cut_observed(more if seen is None else more.join(seen, "id", "left_anti"))
    rounds = 0
    while new["rows"]:
        rounds += 1
        seen = frontier if seen is None else seen.unionByName(frontier)
        if rounds % COMPACT == 0:
            seen = cut(seen)
        step = frontier.join(links, F.col("id") == F.col("a")).select(F.col("b").alias("id")).distinct()
        frontier, new = cut_observed(step.join(seen, "id", "left_anti"))
    return seen if seen is not None else frontier


def scope_ids(graph: Graph) -> DataFrame:
    """(id): the nodes in scope.

    Begins with anchors and all their neighbours. Each round adds nodes on directed paths between kept nodes; code next to
    any bridge that touches kept nodes or lies on their flow; and bridges that touch kept nodes or are reached from them,
    in this order, until nothing is added. Without anchors the scope is empty.
    """
    forward, backward = cut(arcs(graph.edges)), cut(arcs(graph.edges, BACKWARD))
    around = cut(forward.unionByName(backward.select("a", "b")).distinct())
    kinds = cut(graph.nodes.select("id", is_anchor(F.col("type")).alias("anchor"), is_code(F.col("type")).alias("code"), is_bridge(F.col("type")).alias("bridge")))
    touching = lambda ids: around.join(ids, F.col("a") == F.col("id"), "left_semi").select(F.col("b").alias("id")).distinct()
    anchors, bridges = kinds.filter("anchor").select("id"), kinds.filter("bridge").select("id")
    handlers = cut(kinds.filter("code").select("id").join(touching(bridges), "id", "left_semi"))
    kept, seen = cut_observed(anchors.unionByName(touching(anchors)).distinct())
    size, reached, reaching = seen["rows"], None, None
    while size:
        reached, reaching = _extend(forward, reached, kept), _extend(backward, reaching, kept)
        if size >= 2:
            kept = kept.unionByName(reached.intersect(reaching)).distinct()
        flow = touching(kept).unionByName(reached).unionByName(reaching)
        added = cut(handlers.join(kept, "id", "left_anti").join(flow, "id", "left_semi"))
        kept = cut(kept.unionByName(added))
        reached = _extend(forward, reached, added)
        grown = kept.unionByName(bridges.join(kept, "id", "left_anti").join(touching(kept).unionByName(reached), "id", "left_semi"))
        kept, seen = cut_observed(grown)
        before, size = size, seen["rows"]
        if size == before:
            break
    return kept


def lineage_scope(graph: Graph) -> Graph:
    """The subgraph between the nodes in scope; applying it again changes nothing."""
    return induced(graph, scope_ids(graph))
