"""Filters, searches and inspections of a graph, as the viewer and the command line offer them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.ids import display_name, layer_of
from weft.operators.blocks import Blocks
from weft.operators.model import Graph, induced
from weft.operators.traverse import BACKWARD, arcs, column_order, components, layers, walk
from weft.session import cut_observed


def with_context(graph: Graph, matches: DataFrame) -> Graph:
    """The matching nodes (id), their direct neighbours, and the edges that touch a match."""
    ids = matches.select("id").distinct()
    both = arcs(graph.edges).unionByName(arcs(graph.edges, BACKWARD))
    near = both.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id"))
    return induced(graph, ids.unionByName(near))


def by_type(graph: Graph, kinds: list[str], mode: str = "only") -> Graph:
    """Nodes of the types alone (``only``) or with their neighbours (``context``)."""
    matches = graph.nodes.filter(F.col("type").isin(*kinds)).select("id")
    return with_context(graph, matches) if mode == "context" else induced(graph, matches)


def search(graph: Graph, text: str) -> Graph:
    """Nodes with the text in id, name, type or label, whatever the case, and their neighbours."""
    shown = F.lower(F.concat_ws(" ", "name", "id", "type", display_name(F.col("name"), F.col("type"))))
    return with_context(graph, graph.nodes.filter(shown.contains(text.lower())).select("id"))


def namespaces(nodes: DataFrame) -> DataFrame:
    """(id, layer, rank): bronze, silver and gold with ranks 0 to 2; others are left out."""
    layer = layer_of(F.col("id"))
    rank = F.when(F.col("layer") == "bronze", 0).when(F.col("layer") == "silver", 1).otherwise(2)
    return nodes.select("id", layer.alias("layer")).filter("layer is not null").withColumn("rank", rank)


def connections(graph: Graph, node: str) -> DataFrame:
    """(direction, id, type, relation, confidence, evidence): the edges of one node, seen from it."""
    cols = ["type", "confidence", F.array_join("evidence", "|").alias("evidence")]
    into = graph.edges.filter(F.col("target") == node).select(F.lit("upstream").alias("direction"), F.col("source").alias("id"), *cols)
    out = graph.edges.filter(F.col("source") == node).select(F.lit("downstream").alias("direction"), F.col("target").alias("id"), *cols)
    label = F.when(F.col("evidence") != "", F.col("evidence")).otherwise(F.col("type"))
    return into.unionByName(out).withColumn("relation", label)


def hidden_hops(asset_edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, target, position, id, name): the full path behind each contracted edge."""
    via = F.from_json(F.col("metadata")["via"], "array<string>")
    path = asset_edges.select("source", "target", F.posexplode(F.concat(F.array("source"), via, F.array("target"))).alias("position", "id"))
    return path.join(nodes.select("id", "name"), "id", "left").select("source", "target", "position", "id", "name")


def focus(graph: Graph, node: str) -> Graph:
    """The weakly connected component of one node."""
    labels = components(graph.nodes, graph.edges)
    own = labels.filter(F.col("id") == node).select("component")
    return induced(graph, labels.join(own, "component", "left_semi").select("id"))


def highlight(graph: Graph, node: str, mode: str) -> DataFrame:
    """(id): the node with its upstream, downstream, both (one step each) or impact (all that depends on it)."""
    start = graph.nodes.sparkSession.createDataFrame([(node,)], "id string")
    parts = [start]
    if mode in ("upstream", "both"):
        parts.append(walk(graph.edges, start, forward=False, max_depth=1).select("id"))
    if mode in ("downstream", "both"):
        parts.append(walk(graph.edges, start, max_depth=1).select("id"))
    if mode == "impact":
        parts.append(walk(graph.edges, start).select("id"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def excerpts(cited: DataFrame, files: DataFrame, around: int = 5) -> DataFrame:
    """(file_path, line_number, first_line, excerpt): at most 2 * around + 1 lines about each cited line.

    ``cited``: (file_path, line_number); ``files``: (file_path, content). Only files in the table can be joined, so no path
    can escape; lines outside the file give nothing.
    """
    lines = F.split(F.regexp_replace("content", "\r\n?", "\n"), "\n", -1)
    first = F.greatest(F.lit(1), F.col("line_number") - around)
    size = F.col("line_number") + around - first + 1
    joined = cited.distinct().join(files.select("file_path", lines.alias("lines")), "file_path").filter("line_number between 1 and size(lines)")
    return joined.select("file_path", "line_number", first.alias("first_line"), F.array_join(F.slice("lines", first, size), "\n").alias("excerpt"))


def first_line_matching(content: Column, needles: list[str]) -> Column:
    """The first 1-based line that contains any needle; null if none does."""
    hit = lambda line: F.greatest(F.lit(False), *(line.contains(n) for n in needles))
    flags = F.transform(F.split(content, "\n", -1), hit)
    return F.nullif(F.array_position(flags, True), F.lit(0).cast("long"))


def suffixed_ids(nodes: DataFrame, cleaned: Column) -> DataFrame:
    """(id, shown): unique short ids; in the order of ids each node gets its clean id, or else the first of ``_2``,
    ``_3`` and so on after it that no node before it has.

    Nodes propose names and each name goes to the smallest id that wants it, until no two want the same: as all names
    prefer smaller ids, this ends where going through the ids one by one does. A node never gets a smaller number than
    its place among those with the same clean id, so it begins there, and further rounds are for clean ids that look
    numbered themselves.
    """
    own = Window.partitionBy("clean").orderBy("id")
    state = nodes.select("id", cleaned.alias("clean")).withColumn("n", F.row_number().over(own))
    shown = F.when(F.col("n") == 1, F.col("clean")).otherwise(F.concat("clean", F.lit("_"), "n"))
    while True:
        state = state.withColumn("shown", shown)
        beaten = F.col("id") != F.min("id").over(Window.partitionBy("shown"))
        state, seen = cut_observed(state.withColumn("beaten", beaten), beaten=F.count_if("beaten"))
        if not seen["beaten"]:
            return state.select("id", "shown")
        state = state.select("id", "clean", (F.col("n") + F.col("beaten").cast("int")).alias("n"))


# Boxes of the drawing, gaps between them and between components, and where rows of components wrap; fixed values.
BOX_WIDTH, BOX_HEIGHT, GAP_X, GAP_Y = 188, 52, 86, 36
BLOCK_GAP_X, BLOCK_GAP_Y = 120, 90
MAX_ROW_WIDTH, MAX_ROW_HEIGHT = 5200, 1600


def pack_blocks(blocks: list[tuple[str, int, int]]) -> dict[str, tuple[int, int]]:
    """Left and top of each block (name, width, height), put in rows that wrap when they get too wide or high."""
    out, top, left, height = {}, 0, 0, 0
    for name, w, h in blocks:
        if left and (left + w > MAX_ROW_WIDTH or (height and max(height, h) > MAX_ROW_HEIGHT)):
            top, left, height = top + height + BLOCK_GAP_Y, 0, 0
        out[name] = (left, top)
        left, height = left + w + BLOCK_GAP_X, max(height, h)
    return out


def numbered(df: DataFrame) -> DataFrame:
    """``df`` in the order of ``id`` with a running number ``at`` from 0: sorted by ranges, whose sizes are added up."""
    ranged = cut_observed(df.sort("id").withColumn("part", F.spark_partition_id()).withColumn("k", F.monotonically_increasing_id()))[0]
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("size"), F.min("k").alias("first"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = sizes.select("part", (F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return ranged.join(F.broadcast(offsets), "part").select(*df.columns, (F.col("k") + F.col("shift")).alias("at"))


def _drawn(graph: Graph) -> DataFrame:
    """(id, component, size, at, position): the column and the place in it of each node, and the size of its component."""
    blocks = Blocks(graph.nodes, graph.edges)
    placed = blocks.layers()
    codes = blocks.components(components) if placed is not None else None
    if codes is not None:  # without cycles a component has nodes in every layer up to its last
        ordered = blocks.stored(blocks.order(codes, placed, 3, strict=True).join(blocks.names, "r").select("id", "code", F.col("layer").alias("at"), "position"))
        named = ordered.groupBy("code").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("component"))
        return blocks.stored(ordered.join(named, "code").select("id", "component", "size", "at", "position"))
    labels = components(graph.nodes, graph.edges)
    size = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    labels = blocks.stored(labels.join(size, "component"))
    grouped = labels.filter("size > 1")
    heads = graph.edges.select(F.col("target").alias("id")).filter("source <> target")
    rooted = grouped.join(heads, "id", "left_anti").select("id", "component")
    headless = grouped.select("component").distinct().join(rooted, "component", "left_anti").select(F.col("component").alias("id"))
    placed = layers(grouped, graph.edges, starts=headless).join(grouped.select("id", "component"), "id")
    ordered = blocks.stored(column_order(placed, graph.edges))
    column = F.dense_rank().over(Window.partitionBy("component").orderBy("layer")) - 1
    columns = ordered.select("component", "layer").distinct().select("component", "layer", column.alias("at"))
    found = ordered.join(columns, ["component", "layer"]).join(size, "component").select("id", "component", "size", "at", "position")
    return found.unionByName(labels.filter("size = 1").select("id", "component", "size", F.lit(0).alias("at"), F.lit(0).alias("position")))


def layout(graph: Graph) -> DataFrame:
    """(id, component, x, y): boxes in columns by layer, larger components first, single nodes as a grid at the end.

    Places are computed on executors; only the size of each component that is drawn comes to the driver for packing.
    """
    drawn = _drawn(graph)
    grouped, single = drawn.filter("size > 1"), drawn.filter("size = 1")
    boxes = grouped.select("id", "component", (F.col("at") * (BOX_WIDTH + GAP_X)).alias("x"), (F.col("position") * (BOX_HEIGHT + GAP_Y)).alias("y"))
    count = single.count()
    rows = -(-count // max(1, -(-count // max(1, MAX_ROW_HEIGHT // (BOX_HEIGHT + GAP_Y))))) if count else 1
    single, at = numbered(single.select("id")), F.col("at")
    grid = single.select("id", F.lit("").alias("component"), (F.floor(at / rows).cast("int") * (BOX_WIDTH + GAP_X)).alias("x"), (at % rows * (BOX_HEIGHT + GAP_Y)).alias("y"))
    extent = lambda df: df.groupBy("component").agg((F.max("x") + BOX_WIDTH).alias("w"), (F.max("y") + BOX_HEIGHT).alias("h"), F.count(F.lit(1)).alias("n"))
    blocks = [tuple(r)[:3] for r in extent(boxes).orderBy(F.col("n").desc(), F.col("w").desc(), "component").collect()] + [tuple(r)[:3] for r in extent(grid).collect()]
    corners = graph.nodes.sparkSession.createDataFrame([(c, x, y) for c, (x, y) in pack_blocks(blocks).items()], "component string, left int, top int")
    return boxes.unionByName(grid).join(corners, "component").select("id", "component", (F.col("x") + F.col("left")).alias("x"), (F.col("y") + F.col("top")).alias("y"))
