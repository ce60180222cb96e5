"""The graph model: schemas, type classes, and the order-independent merges of nodes and edges.

An edge ``A -> B`` means that B depends on A; impact walks with the arrows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE_SCHEMA = "id string, name string, type string, file_path string, line_number int, metadata map<string,string>"
EDGE_SCHEMA = "source string, target string, type string, confidence tinyint, evidence array<string>, metadata map<string,string>"

LOW, MEDIUM, HIGH = 0, 1, 2
CONFIDENCE = ("low", "medium", "high")

#: Types of data and AI objects around which lineage is kept; fixed values.
ANCHOR_TYPES = (
    "sql_table", "dbt_model", "dbt_source", "llm", "embedding_model", "vector_store", "vector_collection", "langgraph_node",
    "external_system", "pipeline_dataset", "django_model", "sqlalchemy_model",
)
#: Types that the asset view shows; fixed values.
ASSET_TYPES = (*ANCHOR_TYPES, "api_route", "agent")
_CODE = r"(_function|_module|_class|_method|_file)$"


def is_anchor(kind: Column) -> Column:
    return F.coalesce(kind.isin(*ANCHOR_TYPES), F.lit(False))


def is_code(kind: Column) -> Column:
    """Code of any language, by the end of the type."""
    return F.coalesce(F.lower(F.trim(kind)).rlike(_CODE), F.lit(False))


def is_bridge(kind: Column) -> Column:
    """Neither anchor nor code; unknown types are bridges."""
    return ~is_anchor(kind) & ~is_code(kind)


def is_asset(kind: Column) -> Column:
    return F.coalesce(kind.isin(*ASSET_TYPES), F.lit(False))


@dataclass
class Graph:
    """Nodes and edges; both are lazy DataFrames in the schemas above."""

    nodes: DataFrame
    edges: DataFrame


def merge_metadata(rows: DataFrame, keys: list[str], column: str = "metadata") -> DataFrame:
    """``keys`` and a map merged per key: nulls and blanks lose, and of several values the smallest as text is kept.

    Values are JSON texts; they compare by the text they stand for, so 10 comes before 9 and True is ``True``.
    """
    long = rows.select(*keys, F.explode(column).alias("_k", "_v")).filter("_v is not null and _v not in ('', '\"\"', 'null')")
    shown = F.when(F.col("_v") == "true", "True").when(F.col("_v") == "false", "False").otherwise(F.regexp_replace("_v", '^"|"$', ""))
    best = long.groupBy(*keys, "_k").agg(F.min(F.struct(shown.alias("s"), F.col("_v").alias("v"))).alias("_b"))
    return best.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_b.v")))).alias(column))


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One row an id: smallest non-empty name, type and file_path, smallest line, merged metadata. Null ids are dropped."""
    nodes = nodes.filter("id is not null")
    filled = lambda c: F.min(F.nullif(F.col(c), F.lit(""))).alias(c)
    plain = nodes.groupBy("id").agg(filled("name"), filled("type"), filled("file_path"), F.min("line_number").alias("line_number"))
    return _with_metadata(plain, merge_metadata(nodes, ["id"]), ["id"])


def merge_edges(edges: DataFrame) -> DataFrame:
    """One row per source, target and type: highest confidence, evidence as the sorted set of tokens, merged metadata.

    The evidence of a merge is a set, so the result does not depend on the order or nesting of merges. Edges with a
    null end or type are dropped; a null confidence counts as low.
    """
    keys = ["source", "target", "type"]
    edges = edges.filter("source is not null and target is not null and type is not null")
    tokens = F.array_sort(F.array_distinct(F.flatten(F.collect_set("evidence"))))
    plain = edges.groupBy(*keys).agg(F.max(F.coalesce("confidence", F.lit(LOW))).cast("tinyint").alias("confidence"), tokens.alias("evidence"))
    return _with_metadata(plain, merge_metadata(edges, keys), keys)


def _with_metadata(plain: DataFrame, metadata: DataFrame, keys: list[str]) -> DataFrame:
    empty = F.create_map().cast("map<string,string>")
    joined = plain.join(metadata, keys, "left")
    return joined.withColumn("metadata", F.coalesce("metadata", empty))


def adjacency(edges: DataFrame) -> DataFrame:
    """(source, targets): distinct neighbours in order, for display; joins use the edges themselves."""
    pairs = edges.select("source", "target").distinct()
    return pairs.groupBy("source").agg(F.array_sort(F.collect_list("target")).alias("targets"))


def induced(graph: Graph, keep: DataFrame) -> Graph:
    """The nodes in ``keep`` (id) and the edges between them."""
    ids = keep.select("id").distinct()
    edges = graph.edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return Graph(graph.nodes.join(ids, "id", "left_semi"), edges.select(*graph.edges.columns))


def unresolved_import(nodes: DataFrame) -> Column:
    """A module that was imported but not scanned."""
    return (F.col("type") == "python_module") & F.coalesce(F.col("file_path"), F.lit("")).isin("") & (F.coalesce(F.col("metadata")["imported"], F.lit("")) == "true")


def build_graph(facts_nodes: DataFrame, facts_edges: DataFrame) -> tuple[Graph, DataFrame]:
    """The merged graph of all facts, and the warnings (message) about dangling edges.

    Modules that were only imported vanish with their edges; edges to or from unknown nodes are dropped, with a
    warning unless they are provisional.
    """
    nodes, edges = merge_nodes(facts_nodes), merge_edges(facts_edges)
    gone = nodes.filter(unresolved_import(nodes)).select("id")
    nodes = nodes.join(gone, "id", "left_anti")
    for end in ("source", "target"):
        edges = edges.join(gone.withColumnRenamed("id", end), end, "left_anti")
    columns = ["source", "target", "type", "confidence", "evidence", "metadata"]
    ids = nodes.select("id", F.lit(True).alias("there"))
    checked = edges.join(ids.select(F.col("id").alias("source"), F.col("there").alias("has_source")), "source", "left")
    checked = checked.join(ids.select(F.col("id").alias("target"), F.col("there").alias("has_target")), "target", "left")
    whole = F.coalesce(F.col("has_source") & F.col("has_target"), F.lit(False))
    provisional = F.coalesce(F.col("metadata")["provisional"], F.lit("")) == "true"
    message = F.concat(F.lit("Dropped dangling edge "), "source", F.lit(" -> "), "target", F.lit(" ("), "type", F.lit(")"))
    warnings = checked.filter(~whole & ~provisional).select(message.alias("message"))
    return Graph(nodes, checked.filter(whole).select(*columns)), warnings


def type_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("type").agg(F.count(F.lit(1)).alias("nodes"))
