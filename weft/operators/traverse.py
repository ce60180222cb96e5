"""Walks, closures, paths, components and layers, as loops of joins over edges.

Every round is one job that writes its result to the shared checkpoint folder, so plans stay small and a lost executor
costs one round. Frontiers are anti-joined with what has been seen; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.blocks import Blocks
from weft.session import cut, cut_observed

FORWARD, BACKWARD = True, False
#: After so many rounds the parts of what was seen are written as one.
COMPACT = 12
#: Links of paths up to which they are sent to every task (about 100 bytes each), counted first.
BROADCAST_LINKS = 200_000
#: Nodes by which paths grow in one job where their links are sent to every task.
STEPS = 6


def arcs(edges: DataFrame, forward: bool = FORWARD) -> DataFrame:
    """(a, b): distinct links in walking direction."""
    a, b = ("source", "target") if forward else ("target", "source")
    return edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null").distinct()


def walk(edges: DataFrame, starts: DataFrame, *, forward: bool = FORWARD, max_depth: int | None = None) -> DataFrame:
    """(start, id, depth): what each ``id`` in ``starts`` reaches, at its shortest distance, the start itself left out.

    Cycles end the walk; a start that is nowhere an end reaches nothing; repeated starts count once.
    """
    links = cut(arcs(edges, forward))
    seen = starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("depth")).distinct()
    frontier, depth = seen, 0
    found = None
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.join(links, F.col("id") == F.col("a")).select("start", F.col("b").alias("id")).distinct()
        frontier, new = cut_observed(step.join(seen.select("start", "id"), ["start", "id"], "left_anti").select("start", "id", F.lit(depth).alias("depth")))
        if not new["rows"]:
            break
        found = frontier if found is None else found.unionByName(frontier)
        seen = seen.unionByName(frontier)
        if depth % COMPACT == 0:
            found, seen = cut(found), cut(seen)
    return found if found is not None else seen.filter("depth > 0")


def neighbours(edges: DataFrame, start: str, *, forward: bool = FORWARD) -> DataFrame:
    """(id): direct neighbours of one node."""
    return arcs(edges, forward).filter((F.col("a") == start) & (F.col("b") != start)).select(F.col("b").alias("id"))


def reachable(edges: DataFrame, starts: DataFrame, *, forward: bool = FORWARD) -> DataFrame:
    """(id): everything that any start reaches, the starts included."""
    links = cut(arcs(edges, forward))
    seen = cut(starts.select("id").distinct())
    frontier, rounds = seen, 0
    while True:
        rounds += 1
        step = frontier.join(links, F.col("id") == F.col("a")).select(F.col("b").alias("id")).distinct()
        frontier, new = cut_observed(step.join(seen, "id", "left_anti"))
        if not new["rows"]:
            return seen
        seen = seen.unionByName(frontier)
        if rounds % COMPACT == 0:
            seen = cut(seen)


def connectors(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """(id): nodes on a directed path from one kept node to another, the kept ones included; empty for fewer than two."""
    both = reachable(edges, kept).intersect(reachable(edges, kept, forward=BACKWARD))
    enough = kept.select("id").distinct().agg((F.count(F.lit(1)) >= 2).alias("enough")).scalar()
    return both.filter(enough)


def impact(nodes: DataFrame, edges: DataFrame, start: str, max_depth: int | None = None) -> DataFrame:
    """(id, name, type, depth) of everything that depends on ``start``."""
    spark = nodes.sparkSession
    reached = walk(edges, spark.createDataFrame([(start,)], "id string"), max_depth=max_depth).select("id", "depth")
    return reached.join(nodes.select("id", "name", "type"), "id").select("id", "name", "type", "depth")


def impact_summary(impacted: DataFrame) -> DataFrame:
    """(affected, direct, transitive): direct has depth 1, transitive more."""
    return impacted.agg(F.count(F.lit(1)).alias("affected"), F.count_if(F.col("depth") == 1).alias("direct"), F.count_if(F.col("depth") >= 2).alias("transitive"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id of each weakly connected component.

    Alternating large-star and small-star steps: each node links its larger neighbours to its smallest one, so that
    chains shrink by doubling and the rounds grow with the logarithm of the diameter.
    """
    pairs = edges.select(F.col("source").alias("u"), F.col("target").alias("v")).filter("u is not null and v is not null and u <> v")
    links = cut(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        links, state = cut_observed(small.filter("u <> v").distinct(), digest=F.bit_xor(F.xxhash64("u", "v")))
        if state == before:
            break
        before = state
    label = links.groupBy("u").agg(F.min("v").alias("m"))
    return nodes.select("id").join(label, F.col("id") == F.col("u"), "left").select("id", F.coalesce("m", "id").alias("component"))


def _spread(links: DataFrame, starts: DataFrame) -> DataFrame:
    """(a, x): the smallest ``x`` of ``starts`` (a, x) that reaches each node along ``links`` (a, b), itself included."""
    state, seen = cut_observed(starts.select("a", "x", F.lit(True).alias("new")), new=F.count_if("new"))
    while seen["new"]:
        push = state.filter("new").join(links, "a").groupBy(F.col("b").alias("a")).agg(F.min("x").alias("y"))
        better = F.coalesce(F.col("y") < F.col("x"), F.col("y").isNotNull())
        step = state.join(push, "a", "full").select("a", F.least("x", "y").alias("x"), better.alias("new"))
        state, seen = cut_observed(step, new=F.count_if("new"))
    return state.select("a", "x")


def strong_components(ids: DataFrame, links: DataFrame) -> DataFrame:
    """(id, strong): the smallest id of each strongly connected component of ``ids`` (id) and ``links`` (a, b).

    Each round gives every node the smallest id that reaches it; the nodes with an id that this id's node is also
    reached from within the same colour are its component. Rounds end as every one takes at least one component of each
    colour away. Nodes without any link on one side are components of their own and never walked.
    """
    left, out = cut(ids.select("id").distinct()), None
    links = cut(links.select("a", "b").filter("a <> b").distinct())
    while True:
        inner = left.join(links.select(F.col("a").alias("id")).distinct(), "id", "left_semi").join(links.select(F.col("b").alias("id")).distinct(), "id", "left_semi")
        inner, seen = cut_observed(inner)
        alone = left.join(inner, "id", "left_anti").select("id", F.col("id").alias("strong"))
        out = alone if out is None else cut(out.unionByName(alone))
        if not seen["rows"]:
            return out
        within = lambda df: df.join(inner.select(F.col("id").alias("a")), "a", "left_semi").join(inner.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b")
        if seen["rows"] < left.count():  # peel before colours are spread
            left, links = inner, cut(within(links))
            continue
        colour = _spread(links, inner.select(F.col("id").alias("a"), F.col("id").alias("x")))
        same = links.join(colour.withColumnRenamed("x", "ca"), "a").join(colour.select(F.col("a").alias("b"), F.col("x").alias("cb")), "b").filter("ca = cb")
        back = _spread(cut(same.select(F.col("b").alias("a"), F.col("a").alias("b"))), colour.filter("a = x"))
        out = cut(out.unionByName(back.select(F.col("a").alias("id"), F.col("x").alias("strong"))))
        left = cut(inner.join(out, "id", "left_anti"))
        gone = left.select("id")
        links = cut(links.join(gone.select(F.col("id").alias("a")), "a", "left_semi").join(gone.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b"))


def _finish(state: DataFrame, links: DataFrame) -> DataFrame:
    """(id, layer, waiting) once every node that can has passed ``layer`` plus ``step`` of ``links`` (a, b, step) on."""
    state, seen = cut_observed(state.withColumn("new", F.col("waiting") == 0), ready=F.count_if("new"))
    while seen["ready"]:
        push = state.filter("new").join(links, F.col("id") == F.col("a")).groupBy("b").agg(F.max(F.col("layer") + F.col("step")).alias("up"), F.count(F.lit(1)).alias("done"))
        left = F.col("waiting") - F.coalesce("done", F.lit(0))
        step = state.join(push, F.col("id") == F.col("b"), "left").select(
            "id", F.greatest("layer", F.coalesce("up", F.lit(0))).alias("layer"), left.alias("waiting"), ((F.col("waiting") > 0) & (left == 0)).alias("new")
        )
        state, seen = cut_observed(step, ready=F.count_if("new"))
    return state.select("id", "layer", "waiting")


def layers(nodes: DataFrame, edges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(id, layer): the longest distance from a root, a node without incoming edges or one of ``starts`` (id).

    A node passes its layer on once all its predecessors have, so there are as many rounds as layers. Nodes that wait
    for each other form strongly connected components: one begins at the layer after all that comes before it, at the
    nodes entered from outside, or at its smallest id where there are none; its other nodes follow by their distance from
    these, and what comes behind it follows the nodes it hangs on. So every node lies behind all it depends on but
    for edges that lead back within a cycle.
    """
    links = arcs(edges).filter("a <> b")
    if starts is not None:
        links = links.join(starts.select(F.col("id").alias("b")), "b", "left_anti")
    links = cut(links.select("a", "b", F.lit(1).alias("step")))
    count = lambda links: links.groupBy(F.col("b").alias("id")).agg(F.count(F.lit(1)).alias("waiting"))
    begin = nodes.select("id").distinct().join(count(links), "id", "left").select("id", F.lit(0).alias("layer"), F.coalesce("waiting", F.lit(0)).alias("waiting"))
    state = _finish(begin, links)
    stuck, seen = cut_observed(state.filter("waiting > 0"))
    if not seen["rows"]:
        return state.select("id", "layer")
    ends = lambda df, c: df.join(stuck.select(F.col("id").alias(c)), c, "left_semi")
    inner = cut(ends(ends(links, "a"), "b").select("a", "b"))
    strong = strong_components(stuck, inner)
    named = inner.join(strong.select(F.col("id").alias("a"), F.col("strong").alias("sa")), "a").join(strong.select(F.col("id").alias("b"), F.col("strong").alias("sb")), "b")
    named = cut(named)
    # distances within components, from the nodes that are entered
    entered = ends(links, "b").join(named.filter("sa = sb").select("a", "b"), ["a", "b"], "left_anti").select(F.col("b").alias("id")).distinct()
    heads = strong.join(entered, "id", "left_semi")
    heads = heads.unionByName(strong.filter("id = strong").join(heads.select("strong").distinct(), "strong", "left_anti").select("id", "strong"))
    ring = named.filter("sa = sb").select(F.col("a").alias("source"), F.col("b").alias("target"))
    far = walk_depths(ring, heads.select("id"))
    placed = cut(strong.join(far, "id").join(stuck.select("id", "layer"), "id"))
    condensed = named.filter("sa <> sb").join(placed.select(F.col("id").alias("a"), "depth"), "a").groupBy(F.col("sa").alias("a"), F.col("sb").alias("b")).agg((F.max("depth") + 1).alias("step"))
    condensed = cut(condensed)
    begin = placed.groupBy(F.col("strong").alias("id")).agg(F.max("layer").alias("layer"))
    base = _finish(begin.join(count(condensed), "id", "left").select("id", "layer", F.coalesce("waiting", F.lit(0)).alias("waiting")), condensed)
    late = placed.join(base.select(F.col("id").alias("strong"), F.col("layer").alias("base")), "strong").select("id", (F.col("base") + F.col("depth")).alias("layer"))
    return state.filter("waiting = 0").select("id", "layer").unionByName(late)


def walk_depths(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(id, depth): the shortest distance of every node from any of ``starts`` (id), the starts at 0."""
    links = cut(arcs(edges))
    seen = frontier = cut(starts.select("id", F.lit(0).alias("depth")).distinct())
    depth = 0
    while True:
        depth += 1
        step = frontier.join(links, F.col("id") == F.col("a")).select(F.col("b").alias("id")).distinct()
        frontier, new = cut_observed(step.join(seen.select("id"), "id", "left_anti").select("id", F.lit(depth).alias("depth")))
        if not new["rows"]:
            return seen
        seen = seen.unionByName(frontier)
        if depth % COMPACT == 0:
            seen = cut(seen)


def root_paths(nodes: DataFrame, edges: DataFrame, limit: int | None = 80, max_length: int | None = None) -> DataFrame:
    """(out, path): simple paths from roots to sinks as arrays of ids, in depth-first order, which is by ``out``, true
    first, then by path.

    Roots have no incoming edge; if there is none, every node is one. A path ends at a sink or before a node that it
    already has; edges to ids that are no nodes lead nowhere. Roots with outgoing edges come first, then ids in order;
    ``limit`` keeps the first paths, as printed, and as every path that grows ends in at least one of them, no more than
    ``limit`` are kept in any round. Without a limit the work is that of all paths. A path of more than ``max_length``
    nodes is an error.
    """
    links = cut(arcs(edges))
    ids = nodes.select("id").distinct()
    roots = ids.join(links.select(F.col("b").alias("id")), "id", "left_anti")
    if roots.isEmpty():
        roots = ids
    going = links.select(F.col("a").alias("id"), F.lit(True).alias("out")).distinct()
    links, few = cut_observed(links.join(ids.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b"))
    if few["rows"] <= BROADCAST_LINKS:
        near = F.broadcast(cut(links.groupBy("a").agg(F.collect_list("b").alias("near"))))
        grow = lambda df: _grow_near(df, near)
    else:
        grow = lambda df: _grow(df, links)
    state = roots.join(going, "id", "left").select(F.coalesce("out", F.lit(False)).alias("out"), F.array("id").alias("path"), F.lit(True).alias("open"))
    first = lambda df: df.orderBy(F.col("out").desc(), "path").limit(limit) if limit is not None else df
    steps = 1 if limit is not None or max_length is not None or few["rows"] > BROADCAST_LINKS else STEPS
    done, length, rounds = None, 0, 0
    while True:
        state, seen = cut_observed(first(state), open=F.count_if("open"))
        if limit is None:
            ended = state.filter("not open")
            done = ended if done is None else done.unionByName(ended)
            state = state.filter("open")
        if not seen["open"]:
            ready = state if limit is not None else done
            return ready.orderBy(F.col("out").desc(), "path").select("out", "path")
        length, rounds = length + steps, rounds + 1
        if max_length is not None and length > max_length:
            raise ValueError(f"there are paths of more than {max_length} nodes")
        if limit is None and rounds % COMPACT == 0:
            done = cut(done)
        for _ in range(steps):
            state = grow(state)


def _grow_near(state: DataFrame, near: DataFrame) -> DataFrame:
    """Paths (out, path, open) with one node more, where ``near`` (a, near) has few links and is sent to every task."""
    children = F.when(F.col("open"), F.filter(F.coalesce("near", F.array().cast("array<string>")), lambda b: ~F.array_contains("path", b)))
    onward = state.withColumn("a", F.element_at("path", -1)).join(near, "a", "left").select("out", "path", children.alias("c"))
    onward = onward.select("out", "path", F.explode(F.when(F.size("c") > 0, F.col("c")).otherwise(F.array(F.lit(None).cast("string")))).alias("b"))
    return onward.select("out", F.when(F.col("b").isNull(), F.col("path")).otherwise(F.concat("path", F.array("b"))).alias("path"), F.col("b").isNotNull().alias("open"))


def _grow(state: DataFrame, links: DataFrame) -> DataFrame:
    """Paths (out, path, open) with one node more, by joins; a path that cannot grow is not open any more."""
    # numbered from the written rows, so that paths are joined by numbers and not as arrays
    growing = state.filter("open").withColumn("n", F.monotonically_increasing_id())
    onward = growing.withColumn("a", F.element_at("path", -1)).join(links, "a").filter(~F.array_contains("path", F.col("b")))
    stuck = growing.join(onward.select("n").distinct(), "n", "left_anti").select("out", "path", F.lit(False).alias("open"))
    longer = onward.select("out", F.concat("path", F.array("b")).alias("path"), F.lit(True).alias("open"))
    return state.filter("not open").unionByName(longer).unionByName(stuck)


def column_order(placed: DataFrame, edges: DataFrame, sweeps: int = 3) -> DataFrame:
    """(id, component, layer, position): places within layers after barycentre sweeps.

    ``placed``: (id, component, layer). Sweeps go forward over incoming and backward over outgoing neighbours in turn,
    layer by layer, each seeing the places of the layers before it. A node without such neighbours takes the others, and
    without any keeps its place. Ties go by bronze, silver, gold and the rest, then by id. Links and places lie in blocks
    (``blocks``), so that a layer and sweep moves some bytes for each link of the layer.
    """
    graph = Blocks(placed, edges)
    placed = graph.stored(placed.select("id", "component", "layer"))
    names, _ = graph.numbered(placed.select("component").distinct(), "code", "component")
    both = graph.stored(graph.labelled(placed.join(names, "component")))
    codes, layered = (both.filter(F.col("kind") == k).select("block", "data") for k in (0, 1))
    found = graph.order(codes, layered, sweeps)
    return found.join(names, "code").join(graph.names, "r").select("id", "component", "layer", "position")


def layered_order(nodes: DataFrame, edges: DataFrame, sweeps: int = 3, component: str = "all") -> DataFrame:
    """``column_order`` by the layers of all nodes, as one component."""
    graph = Blocks(nodes, edges)
    placed = graph.layers()
    if placed is None:  # cycles
        return column_order(layers(nodes, edges).withColumn("component", F.lit(component)), edges, sweeps)
    return graph.order(None, placed, sweeps, strict=True).join(graph.names, "r").select("id", F.lit(component).alias("component"), "layer", "position")
