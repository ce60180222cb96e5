"""Full hierarchies from parent-child links of unknown depth, with cycles told apart.

1. Peeling: jump pointers of doubling length drop every node whose chain of parents ends, and the nodes that are
   still pointed at after 2^k steps are those left when 2^k layers of leaves are peeled, in the end the cycles.
2. The remaining forest gets Euler tours: each link is walked down and up, and the arcs form one linked list per tree.
3. Parallel list ranking by pointer jumping gives every arc its place and the sum of +1 (down) and -1 (up) to the
   end of its list. From the two arcs of a node follow depth, root, number of descendants and an interval that lies
   within the interval of exactly the node's ancestors.

Rounds grow with the logarithm of the depth and of the largest tree. Every round joins on unique keys and is
written to the shared checkpoint folder. Siblings are chained in salted buckets, so that a parent with a third of
all children does not put them into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.session import cut, cut_observed

#: Children of one parent are chained in this many buckets.
SIBLING_BUCKETS = 64


def trimmed(column: Column) -> Column:
    """Without white space around it; a blank text is null."""
    return F.nullif(F.regexp_replace(column, r"(?U)^\s+|\s+$", ""), F.lit(""))


def _peel(parents: DataFrame) -> DataFrame | None:
    """(v, on): the nodes whose parents never end and a node on their cycle; None if there are none."""
    jumps, before = parents.select("v", F.col("p").alias("j")), None
    while True:
        size = jumps.agg(F.count(F.lit(1)), F.count_distinct("j")).first()
        if not size[0]:
            return None
        if tuple(size) == before:
            return jumps.select("v", F.col("j").alias("on"))
        before = tuple(size)
        far = jumps.select(F.col("v").alias("j"), F.col("j").alias("k"))
        jumps = cut(jumps.join(far, "j").select("v", F.col("k").alias("j")))


def _cycle_labels(parents: DataFrame, caught: DataFrame, names: DataFrame) -> DataFrame:
    """(on, label): the smallest name on the cycle of each node on a cycle."""
    on = caught.select(F.col("on").alias("v")).distinct()
    state, seen = cut_observed(parents.join(on, "v", "left_semi").join(names, "v").select("v", F.col("p").alias("j"), F.col("name").alias("m"), F.lit(True).alias("new")), new=F.count_if("new"))
    while seen["new"]:
        far = state.select(F.col("v").alias("j"), F.col("j").alias("k"), F.col("m").alias("fm"))
        step = state.join(far, "j").select("v", F.col("k").alias("j"), F.least("m", "fm").alias("m"), (F.col("fm") < F.col("m")).alias("new"))
        state, seen = cut_observed(step, new=F.count_if("new"))
    return state.select(F.col("v").alias("on"), F.col("m").alias("label"))


def _tour(forest: DataFrame, buckets: int) -> DataFrame:
    """(arc, nxt, root, n, w): the arcs of all Euler tours; 2v walks down to v and 2v + 1 up from it."""
    forest = forest.withColumn("b", F.pmod(F.xxhash64("v"), F.lit(buckets)))
    inside = Window.partitionBy("p", "b").orderBy("v")
    chained = forest.withColumn("sibling", F.lead("v").over(inside))
    ends = forest.groupBy("p", "b").agg(F.min("v").alias("first"), F.max("v").alias("v"))
    across = Window.partitionBy("p").orderBy("b")
    ends = ends.withColumn("next_first", F.lead("first").over(across))
    chained = chained.join(ends.select("v", "next_first"), "v", "left").withColumn("sibling", F.coalesce("sibling", "next_first"))
    first = ends.groupBy("p").agg(F.min(F.struct("b", "first"))["first"].alias("child")).withColumnRenamed("p", "v")
    inner = forest.select(F.col("v").alias("p"), F.lit(True).alias("inner"))
    arcs = chained.join(first, "v", "left").join(inner, "p", "left")
    down = F.struct(
        (F.col("v") * 2).alias("arc"), F.coalesce(F.col("child") * 2, F.col("v") * 2 + 1).alias("nxt"),
        F.lit(None).cast("long").alias("root"), F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("w"),
    )
    up_next = F.coalesce(F.col("sibling") * 2, F.when(F.col("inner"), F.col("p") * 2 + 1))
    up = F.struct(
        (F.col("v") * 2 + 1).alias("arc"), up_next.alias("nxt"),
        F.when(up_next.isNull(), F.col("p")).alias("root"), F.lit(1).cast("long").alias("n"), F.lit(-1).cast("long").alias("w"),
    )
    return arcs.select(F.inline(F.array(down, up)))


def _rank(arcs: DataFrame) -> DataFrame:
    """The arcs with n and w summed from themselves to the end of their list, and root known."""
    state, seen = cut_observed(arcs, going=F.count("nxt"))
    while seen["going"]:
        far = state.select(F.col("arc").alias("nxt"), F.col("nxt").alias("nn"), F.col("root").alias("r"), F.col("n").alias("n2"), F.col("w").alias("w2"))
        step = state.filter("nxt is not null").drop("root").join(far, "nxt")
        step = step.select("arc", F.col("nn").alias("nxt"), F.col("r").alias("root"), (F.col("n") + F.col("n2")).alias("n"), (F.col("w") + F.col("w2")).alias("w"))
        state, seen = cut_observed(state.filter("nxt is null").unionByName(step), going=F.count("nxt"))
    return state


class Hierarchy:
    """The hierarchies of parent-child links.

    A null or blank parent only declares its child, a null child its parent. Repeated links count once; if a child
    has several parents the smallest one holds, and ``other_parents`` tells the rest. No links give empty results.
    """

    def __init__(self, links: DataFrame, parent: str, child: str, *, buckets: int = SIBLING_BUCKETS):
        ends = links.select(trimmed(F.col(parent)).alias("p"), trimmed(F.col(child)).alias("c"))
        names = ends.select(F.explode(F.array("p", "c")).alias("name")).filter("name is not null").distinct()
        self.names = cut(names.select("name", F.monotonically_increasing_id().alias("v")))
        self.ends = ends
        single = ends.filter("p is not null and c is not null").groupBy("c").agg(F.min("p").alias("p"))
        ids = lambda a, b: self.names.select(F.col("name").alias(a), F.col("v").alias(b))
        self.parents = cut(single.join(ids("c", "v"), "c").join(ids("p", "pv"), "p").select("v", F.col("pv").alias("p")))
        self.caught = _peel(self.parents)
        self.forest = self.parents if self.caught is None else cut(self.parents.join(self.caught, "v", "left_anti"))
        self.ranked = _rank(_tour(self.forest, buckets))

    def other_parents(self) -> DataFrame:
        """(node_id, parent_id, kept_id): the parents of a child beyond the one that holds; none in a proper hierarchy."""
        links = self.ends.filter("p is not null and c is not null").distinct()
        kept = links.groupBy("c").agg(F.min("p").alias("kept"))
        return links.join(kept, "c").filter("p <> kept").select(F.col("c").alias("node_id"), F.col("p").alias("parent_id"), F.col("kept").alias("kept_id"))

    def intervals(self) -> DataFrame:
        """(v, root, depth, enter, leave) of every node below a root; a node is above another of its tree exactly
        if it has a larger ``enter`` and a smaller ``leave``."""
        down, up = F.col("arc") % 2 == 0, F.col("arc") % 2 == 1
        return self.ranked.groupBy(F.shiftright("arc", 1).alias("v")).agg(
            F.max("root").alias("root"), F.max(F.when(down, 1 - F.col("w"))).alias("depth"),
            F.max(F.when(down, F.col("n"))).alias("enter"), F.max(F.when(up, F.col("n"))).alias("leave"),
        )

    def nodes(self) -> DataFrame:
        """(node_id, root_id, depth, enter, leave, descendants), one row a node. On or below a cycle depth is -1, root_id
        the smallest id on the cycle, and the rest null."""
        inner = self.intervals()
        roots = self.names.join(self.parents, "v", "left_anti").select(F.col("v"), F.col("v").alias("root"), F.lit(0).cast("long").alias("depth"))
        sizes = inner.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
        roots = roots.join(sizes, "root", "left").select(
            "v", "root", "depth", (F.coalesce("size", F.lit(0)) * 2 + 1).alias("enter"), F.lit(0).cast("long").alias("leave")
        )
        placed = inner.unionByName(roots).join(self.names.withColumnRenamed("name", "node_id"), "v")
        named = self.names.select(F.col("v").alias("root"), F.col("name").alias("root_id"))
        placed = placed.join(named, "root").select(
            "node_id", "root_id", "depth", "enter", "leave", F.expr("(enter - leave - 1) div 2").alias("descendants")
        )
        if self.caught is None:
            return placed
        labels = _cycle_labels(self.parents, self.caught, self.names)
        none = F.lit(None).cast("long")
        below = self.caught.join(labels, "on").join(self.names, "v").select(
            F.col("name").alias("node_id"), F.col("label").alias("root_id"), F.lit(-1).cast("long").alias("depth"),
            none.alias("enter"), none.alias("leave"), none.alias("descendants"),
        )
        return placed.unionByName(below)

    def paths(self, separator: str = " > ") -> DataFrame:
        """(node_id, path): the names from the root to each node outside cycles, joined by doubling jumps."""
        state = self.names.join(self.forest.withColumnRenamed("p", "j"), "v", "left")
        if self.caught is not None:
            state = state.join(self.caught, "v", "left_anti")
        state, seen = cut_observed(state.select("v", "j", F.col("name").alias("path")), going=F.count("j"))
        while seen["going"]:
            far = state.select(F.col("v").alias("j"), F.col("j").alias("k"), F.col("path").alias("upper"))
            step = state.filter("j is not null").join(far, "j").select("v", F.col("k").alias("j"), F.concat_ws(separator, "upper", "path").alias("path"))
            state, seen = cut_observed(state.filter("j is null").unionByName(step), going=F.count("j"))
        return self.names.join(state, "v").select(F.col("name").alias("node_id"), "path")

    def descendants(self, asked: DataFrame | None = None) -> DataFrame:
        """(ancestor_id, node_id) for all nodes outside cycles, or the ``node_id`` rows asked for.

        Every node collects its ancestors by doubling jumps, so the work is the sum of the depths, the size of the list.
        """
        state = self.forest.select("v", F.col("p").alias("j"), F.array("p").alias("above"))
        state, seen = cut_observed(state, going=F.count("j"))
        while seen["going"]:
            far = state.select(F.col("v").alias("j"), F.col("j").alias("k"), F.col("above").alias("upper"))
            step = state.filter("j is not null").join(far, "j", "left").select("v", F.col("k").alias("j"), F.concat("above", F.coalesce("upper", F.array().cast("array<long>"))).alias("above"))
            state, seen = cut_observed(state.filter("j is null").unionByName(step), going=F.count("j"))
        upper = self.names.select(F.col("v").alias("a"), F.col("name").alias("ancestor_id"))
        if asked is not None:
            upper = upper.join(asked.select(F.col("node_id").alias("ancestor_id")).distinct(), "ancestor_id", "left_semi")
        pairs = state.select("v", F.explode("above").alias("a")).join(upper, "a")
        return pairs.join(self.names, "v").select("ancestor_id", F.col("name").alias("node_id"))
