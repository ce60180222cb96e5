import random

import pytest

from weft.operators.hierarchy import Hierarchy
from weft.plans.registry import core_queries


def brute(links):
    names, parent = set(), {}
    for s, t in links:
        s, t = ((x.strip() or None) if x is not None else None for x in (s, t))
        names |= {x for x in (s, t) if x}
        if s and t:
            parent[t] = min(s, parent.get(t, s))
    out = {}
    for v in names:
        path, at = [v], v
        while at in parent and parent[at] not in path:
            at = parent[at]
            path.append(at)
        if at in parent:
            cycle = path[path.index(parent[at]) :]
            out[v] = (min(cycle), -1, None)
        else:
            out[v] = (at, len(path) - 1, " > ".join(reversed(path)))
    return out, parent


def check(spark, links, buckets=64):
    df = spark.createDataFrame(links, "source string, target string")
    tree = Hierarchy(df, "source", "target", buckets=buckets)
    want, parent = brute(links)
    got = {r["node_id"]: r for r in tree.nodes().collect()}
    assert {k: (r["root_id"], r["depth"]) for k, r in got.items()} == {k: v[:2] for k, v in want.items()}
    assert {r[0]: r[1] for r in tree.paths().collect()} == {k: v[2] for k, v in want.items() if v[1] >= 0}
    below = {}
    for v, (_, depth, _) in want.items():
        at = v
        while depth > 0 and at in parent:
            at = parent[at]
            below.setdefault(at, set()).add(v)
    for k, r in got.items():
        if r["depth"] >= 0:
            assert r["descendants"] == len(below.get(k, ()))
            inside = {o for o, x in got.items() if x["depth"] >= 0 and x["root_id"] == r["root_id"] and x["enter"] < r["enter"] and x["leave"] > r["leave"]}
            assert inside == below.get(k, set())
    asked = spark.createDataFrame([(k,) for k in list(got)[:5]], "node_id string")
    pairs = {tuple(r) for r in tree.descendants(asked).collect()}
    assert pairs == {(k, v) for k in list(got)[:5] if got[k]["depth"] >= 0 for v in below.get(k, ())}
    return got


def test_trees_cycles_and_dirt(spark):
    check(
        spark,
        [
            ("r", "a"), (" r ", "a\t"), ("a", "b"), ("r", "c"), (None, "lonely"), ("alone", None), (None, None), ("", "x"), ("x", "y"), ("self", "self"), ("self", "under"),
            ("p", "q"), ("q", "o"), ("o", "p"), ("o", "tail"), ("tail", "tail2"), ("z2", "twice"), ("z1", "twice"),
        ],
    )


def test_deep_chain_and_long_cycle(spark):
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(130)]
    ring = [(f"k{i:02}", f"k{(i + 1) % 37:02}") for i in range(37)] + [("k05", "hang0")] + [(f"hang{i}", f"hang{i + 1}") for i in range(50)]
    check(spark, chain + ring)


@pytest.mark.parametrize("buckets", [1, 4])
def test_random_forest_with_a_hot_parent(spark, buckets):
    rnd = random.Random(buckets)
    links = [("hub", f"h{i}") for i in range(120)]
    for i in range(1, 150):
        links.append((f"n{rnd.randrange(i)}" if rnd.random() > 0.05 else "hub", f"n{i}"))
    rnd.shuffle(links)
    check(spark, links + links[:40], buckets)


def test_empty(spark):
    df = spark.createDataFrame([], "source string, target string")
    tree = Hierarchy(df, "source", "target")
    assert tree.nodes().collect() == [] and tree.paths().collect() == []
    assert check(spark, [(None, "a")]).keys() == {"a"}


def test_descendants_of_every_node(spark):
    links = [(f"c{i}", f"c{i + 1}") for i in range(9)] + [("c0", "x"), ("c4", "y"), ("other", "z"), ("k", "l"), ("l", "k"), ("l", "m"), (None, "alone")]
    got = [tuple(r) for r in Hierarchy(spark.createDataFrame(links, "source string, target string"), "source", "target").descendants().collect()]
    want = {(f"c{i}", f"c{j}") for i in range(10) for j in range(i + 1, 10)} | {("c0", "x"), ("other", "z")} | {(f"c{i}", "y") for i in range(5)}
    assert len(got) == len(want) and set(got) == want


def test_every_asset_is_asked_for_its_descendants(spark, tmp_path):
    links = spark.createDataFrame([(1, "a", "b"), (2, "b", "c"), (50, "r", "s")], "edge_id long, source string, target string")
    links.write.parquet(str(tmp_path / "asset_edges.parquet"))
    got = {tuple(r) for r in core_queries()["p5_all_descendants"](spark, str(tmp_path)).collect()}
    assert got == {("a", "b"), ("a", "c"), ("b", "c"), ("r", "s")}


def test_other_parents_are_told(spark):
    links = spark.createDataFrame([("b", "x"), (" a ", "x"), ("c", "x"), ("c", "x"), ("a", "y"), (None, "x"), ("x", None)], "source string, target string")
    got = sorted(tuple(r) for r in Hierarchy(links, "source", "target").other_parents().collect())
    assert got == [("x", "b", "a"), ("x", "c", "a")]
