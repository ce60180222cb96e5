import random

import pytest
from pyspark.sql import functions as F

from weft.operators import blocks, traverse


def order_by_hand(layer, links, sweeps=3):
    """Places after barycentre sweeps, by plain loops."""
    sort = lambda ids, weight: {x: i for i, x in enumerate(sorted(ids, key=lambda x: (weight[x], x)))}
    at = {}
    for n in set(layer.values()):
        at |= sort([x for x in layer if layer[x] == n], dict.fromkeys(layer, 0))
    for sweep in range(sweeps):
        forward = sweep % 2 == 0
        for n in sorted(range(max(layer.values()) + 1), reverse=not forward):
            weight = {}
            for x in (x for x in layer if layer[x] == n):
                sides = [[at[a] for a, b in links if b == x], [at[b] for a, b in links if a == x]]
                some = [s for s in (sides if forward else sides[::-1]) if s]
                weight[x] = sum(some[0]) / len(some[0]) if some else at[x]
            at |= sort(weight, weight)
    return at


@pytest.mark.parametrize("cyclic", [False, True])
def test_places_found_in_blocks_and_ranges_are_those_of_one_sort(spark, monkeypatch, cyclic):
    monkeypatch.setattr(blocks, "BLOCK", 7)
    monkeypatch.setattr(blocks, "ONE_SORT", 4)
    rnd = random.Random(3)
    ids = [f"n{i:02}" for i in range(20)]
    links = {(a, b) for a, b in ((rnd.choice(ids), rnd.choice(ids)) for _ in range(18)) if cyclic or a < b}
    e = spark.createDataFrame([(a, b) for a, b in links] * 2 + [("n00", "gone"), (None, "n00")], "source string, target string")
    nodes = spark.createDataFrame([(i,) for i in ids], "id string")
    got = {r["id"]: (r["layer"], r["position"]) for r in traverse.layered_order(nodes, e).collect()}
    layer = {r["id"]: r["layer"] for r in traverse.layers(nodes, e).collect()}
    at = order_by_hand(layer, links)
    assert got == {i: (layer[i], at[i]) for i in ids}


def test_links_of_places_are_not_written_as_rows(spark, monkeypatch):
    monkeypatch.setattr(traverse, "cut", lambda df: pytest.fail("rows are written by checkpoints"))
    placed = spark.createDataFrame([(x, "k", i) for i, x in enumerate("abc")], "id string, component string, layer int")
    e = spark.createDataFrame([("a", "b"), ("b", "c")], "source string, target string")
    assert {tuple(r) for r in traverse.column_order(placed, e).select("id", F.col("position")).collect()} == {("a", 0), ("b", 0), ("c", 0)}


def test_components_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 4)
    nodes = spark.createDataFrame([(x,) for x in "abcdefghij"], "id string")
    e = spark.createDataFrame([tuple(p) for p in ("ab", "cb", "dc", "be", "fg", "gh", "ii")], "source string, target string")
    g = blocks.Blocks(nodes, e)
    rows = g.order(g.components(traverse.components), g.layers(), 0).join(g.names, "r").collect()
    found = {}
    for r in rows:
        found.setdefault(r["code"], set()).add(r["id"])
    assert sorted(map("".join, map(sorted, found.values()))) == ["abcde", "fgh", "i", "j"]
    assert g.components(traverse.components, rounds=1) is None
