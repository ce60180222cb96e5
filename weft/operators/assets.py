"""The asset view: chains of implementation between assets contracted into direct edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.model import LOW, Graph, is_asset
from weft.operators.traverse import arcs
from weft.session import cut, cut_observed

#: Bounds of the contraction: hops of a path, paths kept per pair, visits of a node per start; fixed values.
MAX_HOPS, MAX_PATHS, MAX_VISITS = 12, 3, 8


def asset_paths(graph: Graph) -> DataFrame:
    """(source, target, via, place): the first paths between two assets through other nodes, shortest first.

    From each asset the walk goes forward through nodes that are no assets, never back to its start nor twice through a
    node. A node with an asset after it ends the walk there. Nodes are visited in breadth-first order, siblings by id.
    """
    assets = cut(graph.nodes.filter(is_asset(F.col("type"))).select("id").distinct())
    links = arcs(graph.edges).join(assets.select(F.col("id").alias("b"), F.lit(True).alias("t")), "b", "left")
    links = cut(links.select("a", "b", F.coalesce("t", F.lit(False)).alias("to_asset")))
    state = assets.select(F.col("id").alias("start"), F.col("id").alias("cur"), F.array().cast("array<string>").alias("via"))
    visits = assets.select(F.col("id").alias("start"), F.col("id").alias("cur"), F.lit(0).alias("before")).limit(0)
    found = None
    for hops in range(MAX_HOPS + 1):
        state, seen = cut_observed(state)
        if not seen["rows"]:
            break
        onward = state.join(links, F.col("cur") == F.col("a")).filter((F.col("b") != F.col("start")) & ~F.array_contains(F.col("via"), F.col("b")))
        onward = cut(onward.select("start", "cur", "via", "b", "to_asset"))
        hits = onward.filter("to_asset").select(F.col("start").alias("source"), F.col("b").alias("target"), "via")
        found = hits if found is None else found.unionByName(hits)
        if hops == MAX_HOPS:
            break
        stops = onward.filter("to_asset and cur <> start").select("start", "via").distinct()
        steps = onward.filter("not to_asset").join(stops, ["start", "via"], "left_anti")
        order = Window.partitionBy("start", "b").orderBy("via")
        steps = steps.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= MAX_VISITS).join(visits.withColumnRenamed("cur", "b"), ["start", "b"], "left")
        steps = cut(steps.filter(F.col("n") + F.coalesce("before", F.lit(0)) <= MAX_VISITS).select("start", F.col("b").alias("cur"), F.concat("via", F.array("b")).alias("via")))
        counted = steps.groupBy("start", "cur").agg(F.count(F.lit(1)).cast("int").alias("before"))
        visits = cut(visits.unionByName(counted).groupBy("start", "cur").agg(F.sum("before").cast("int").alias("before")))
        state = steps
    if found is None:
        found = graph.edges.limit(0).select("source", "target", F.array().cast("array<string>").alias("via"))
    order = Window.partitionBy("source", "target").orderBy(F.size("via"), "via")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= MAX_PATHS)


def asset_graph(graph: Graph) -> Graph:
    """Assets and their contracted edges of type depends_on.

    Confidence is the lowest of all parallel edges along the first path. Metadata tells the nodes between (via, hops,
    via_labels) and the other paths (alternate_paths) as JSON texts.
    """
    paths = cut(asset_paths(graph))
    first = paths.filter("place = 1")
    hops = first.select("source", "target", F.concat(F.array("source"), "via", F.array("target")).alias("p"))
    hops = hops.select("source", "target", F.explode(F.arrays_zip(F.slice("p", 1, F.size("p") - 1).alias("x"), F.slice("p", 2, F.size("p")).alias("y"))).alias("h"))
    strength = graph.edges.groupBy(F.col("source").alias("x"), F.col("target").alias("y")).agg(F.min(F.coalesce("confidence", F.lit(LOW))).alias("c"))
    weakest = hops.select("source", "target", "h.x", "h.y").join(strength, ["x", "y"]).groupBy("source", "target").agg(F.min("c").alias("confidence"))
    others = paths.filter("place > 1").groupBy("source", "target").agg(F.array_sort(F.collect_list(F.struct("place", "via"))).alias("o"))
    names = graph.nodes.select(F.col("id").alias("node"), "name")
    labels = first.select("source", "target", F.posexplode("via").alias("k", "node")).join(names, "node")
    labels = labels.groupBy("source", "target").agg(F.array_sort(F.collect_list(F.struct("k", "name"))).alias("l"))
    joined = first.join(weakest, ["source", "target"], "left").join(others, ["source", "target"], "left").join(labels, ["source", "target"], "left")
    metadata = F.map_filter(
        F.create_map(
            F.lit("projection"), F.lit('"asset"'), F.lit("via"), F.to_json("via"), F.lit("hops"), F.size("via").cast("string"),
            F.lit("alternate_paths"), F.to_json(F.transform("o", lambda o: o["via"])), F.lit("via_labels"), F.to_json(F.transform("l", lambda x: x["name"])),
        ),
        lambda _, v: v.isNotNull(),
    )
    edges = joined.select(
        "source", "target", F.lit("depends_on").alias("type"), F.coalesce("confidence", F.lit(LOW)).cast("tinyint").alias("confidence"),
        F.array(F.when(F.size("via") == 0, "direct").otherwise("asset projection")).alias("evidence"), metadata.alias("metadata"),
    )
    return Graph(graph.nodes.filter(is_asset(F.col("type"))), edges)
