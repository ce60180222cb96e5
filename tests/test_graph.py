import inspect
import itertools
import random

import pytest
from pyspark.sql import functions as F

from weft.functions.ids import mermaid_id
from weft.operators import assets, identity, model, render, resolve, scope, traverse, views
from weft.operators.model import EDGE_SCHEMA, NODE_SCHEMA, Graph


def nodes(spark, rows):
    return spark.createDataFrame([(i, n, t, None, None, m) for i, n, t, m in ((*r, None, None)[:4] if len(r) < 4 else r for r in rows)], NODE_SCHEMA)


def edges(spark, rows):
    return spark.createDataFrame([(a, b, t, c, e, m) for a, b, t, c, e, m in ((*r, *("x", 1, [], None)[len(r) - 2 :]) for r in rows)], EDGE_SCHEMA)


def graph(spark, kinds, links):
    return Graph(nodes(spark, [(i, i.split(":")[-1], t) for i, t in kinds.items()]), edges(spark, links))


def ids(df):
    return {r["id"] for r in df.collect()}


def test_node_merge_does_not_depend_on_order(spark):
    rows = [("a", "y", "t", "f.py", 9, {"k": "10", "l": '""', "m": "true"}), ("a", "x", "", "", None, {"k": "9", "l": '"v"'}), ("a", None, "s", "g.py", 3, None), (None, "n", "t", "f", 1, None), ("b", None, None, None, None, {})]
    for order in itertools.permutations(rows, len(rows)):
        got = {r["id"]: r for r in model.merge_nodes(spark.createDataFrame(list(order), NODE_SCHEMA)).collect()}
        assert tuple(got["a"])[:5] == ("a", "x", "s", "f.py", 3) and got["a"]["metadata"] == {"k": "10", "l": '"v"', "m": "true"}
        assert got["b"]["metadata"] == {} and set(got) == {"a", "b"}
        break
    again = model.merge_nodes(model.merge_nodes(spark.createDataFrame(rows, NODE_SCHEMA)))
    assert {r["id"]: r["name"] for r in again.collect()} == {"a": "x", "b": None}


def test_edge_merge(spark):
    df = edges(spark, [("a", "b", "x", 0, ["q", "p"], {"k": "1"}), ("a", "b", "x", 2, ["p"], {"k": "0"}), ("a", "b", "y", None, None, None), (None, "b"), ("a", None)])
    got = {r["type"]: r for r in model.merge_edges(df).collect()}
    assert (got["x"]["confidence"], got["x"]["evidence"], got["x"]["metadata"]) == (2, ["p", "q"], {"k": "0"})
    assert (got["y"]["confidence"], got["y"]["evidence"]) == (0, []) and len(got) == 2


def test_build_drops_dangling_and_unresolved(spark):
    n = nodes(spark, [("python_module:a", "a", "python_module", {"python_file": "true"}), ("python_module:os", "os", "python_module", {"imported": "true"}), ("f", "f", "python_function")])
    n = n.withColumn("file_path", F.when(F.col("id") != "python_module:os", "a.py"))
    e = edges(spark, [("python_module:os", "python_module:a", "imported_by"), ("f", "python_module:a"), ("f", "gone", "calls"), ("gone", "f", "calls", 1, [], {"provisional": "true"}), ("f", "f", "self")])
    built, warnings = model.build_graph(n, e)
    assert ids(built.nodes) == {"python_module:a", "f"} and {(r["source"], r["target"]) for r in built.edges.collect()} == {("f", "python_module:a"), ("f", "f")}
    assert [r[0] for r in warnings.collect()] == ["Dropped dangling edge f -> gone (calls)"]


def test_walks_on_cycles_and_depth(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"), ("d", "d"), ("a", "b", "other"), (None, "z")])
    start = spark.createDataFrame([("a",), ("a",), ("nowhere",)], "id string")
    assert {(r["id"], r["depth"]) for r in traverse.walk(e, start).collect()} == {("b", 1), ("c", 2), ("d", 2)}
    assert ids(traverse.walk(e, start, max_depth=1)) == {"b"} and ids(traverse.walk(e, start, forward=False)) == {"b", "c"}
    assert ids(traverse.reachable(e, start)) == {"a", "b", "c", "d", "nowhere"}
    assert ids(traverse.neighbours(e, "d", forward=False)) == {"b"}
    assert traverse.walk(e.limit(0), start).collect() == [] and ids(traverse.connectors(e, start.limit(1))) == set()


def test_components_and_layers_against_brute_force(spark):
    rnd = random.Random(2)
    names = [f"n{i:03}" for i in range(120)]
    links = [(rnd.choice(names), rnd.choice(names)) for _ in range(70)] + [(names[i], names[i + 1]) for i in range(60, 118)]
    label = {n: n for n in names}
    for _ in names:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    g = graph(spark, dict.fromkeys(names, "t"), links)
    assert {r["id"]: r["component"] for r in traverse.components(g.nodes, g.edges).collect()} == label
    down = [(a, b) for a, b in links if a < b]
    depth = dict.fromkeys(names, 0)
    for n in names:
        for a, b in sorted(down):
            depth[b] = max(depth[b], depth[a] + 1)
    got = {r["id"]: r["layer"] for r in traverse.layers(g.nodes, edges(spark, down)).collect()}
    assert got == depth
    cyclic = traverse.layers(g.nodes.limit(0).unionByName(nodes(spark, [("a", "a", "t"), ("b", "b", "t")])), edges(spark, [("a", "b"), ("b", "a")]))
    assert [tuple(r) for r in cyclic.orderBy("id").collect()] == [("a", 0), ("b", 1)]
    assert traverse.components(g.nodes.limit(0), g.edges.limit(0)).collect() == []


def test_root_paths_in_order_with_cycles_and_limit(spark):
    g = graph(spark, dict.fromkeys("abcdxz", "t"), [("a", "c"), ("a", "b"), ("b", "d"), ("d", "b"), ("x", "c")])
    got = [r["path"] for r in traverse.root_paths(g.nodes, g.edges).collect()]
    assert got == [["a", "b", "d"], ["a", "c"], ["x", "c"], ["z"]]
    assert len(traverse.root_paths(g.nodes, g.edges, limit=2).collect()) == 2
    ring = graph(spark, dict.fromkeys("ab", "t"), [("a", "b"), ("b", "a")])
    assert [r["path"] for r in traverse.root_paths(ring.nodes, ring.edges).collect()] == [["a", "b"], ["b", "a"]]


def test_resolve_cascade(spark):
    n = nodes(spark, [("sql_table:a.orders", "orders", "sql_table"), ("sql_table:b.orders", "orders", "sql_table"), ("python_function:m.run", "run", "python_function"), ("api_route:GET:/x", "GET /x", "api_route"), ("dbt_model:Stg", "Stg", "dbt_model")])
    assert resolve.resolve(n, "sql_table:a.orders") == "sql_table:a.orders" and resolve.resolve(n, " a.orders ") == "sql_table:a.orders"
    assert resolve.resolve(n, "run") == "python_function:m.run" and resolve.resolve(n, "stg") == "dbt_model:Stg" and resolve.resolve(n, "/x") == "api_route:GET:/x" and resolve.resolve(n, "get /X") == "api_route:GET:/x"
    with pytest.raises(resolve.AmbiguousNode) as e:
        resolve.resolve(n, "orders")
    assert [n["id"] for n in e.value.candidates] == ["sql_table:a.orders", "sql_table:b.orders"]
    with pytest.raises(resolve.NodeNotFound) as e:
        resolve.resolve(n, "python_function:m.rum")
    assert e.value.suggestions[0]["id"] == "python_function:m.run"
    with pytest.raises(resolve.NodeNotFound):
        resolve.resolve(n, "  ")


def test_scope_keeps_flows_and_drops_the_rest(spark):
    kinds = {
        "sql_table:t": "sql_table", "f:read": "python_function", "f:far": "python_function", "f:helper": "python_function", "route:x": "api_route", "f:handler": "python_function", "m:os": "python_module",
        "route:health": "api_route", "f:health": "python_function", "f:mid": "go_function", "sql_table:u": "sql_table",
    }
    links = [("sql_table:t", "f:read"), ("f:read", "f:mid"), ("f:mid", "f:far"), ("f:far", "sql_table:u"), ("f:read", "f:handler"), ("f:handler", "route:x"), ("f:health", "route:health"), ("f:helper", "m:os")]
    g = graph(spark, kinds, links)
    once = scope.lineage_scope(g)
    assert ids(once.nodes) == {"sql_table:t", "f:read", "f:mid", "f:far", "sql_table:u", "f:handler", "route:x"}
    assert ids(scope.lineage_scope(once).nodes) == ids(once.nodes)
    assert scope.lineage_scope(graph(spark, {"f:a": "python_function"}, [])).nodes.collect() == []


def test_assets_are_contracted(spark):
    kinds = {"t:a": "sql_table", "f1": "python_function", "f2": "python_function", "t:b": "sql_table", "t:c": "dbt_model", "f3": "python_function"}
    links = [("t:a", "f1", "read_by", 2), ("f1", "f2", "invoked_by", 1), ("f2", "t:b", "writes_to", 0), ("f2", "t:b", "feeds", 2), ("t:b", "t:c", "ref", 2), ("f2", "f3", "x", 2), ("f3", "t:c", "x", 2), ("f1", "t:a", "x", 2)]
    view = assets.asset_graph(graph(spark, kinds, links))
    got = {(r["source"], r["target"]): r for r in view.edges.collect()}
    assert set(got) == {("t:a", "t:b"), ("t:b", "t:c")}  # f2 writes an asset, so the walk ends there
    assert (got["t:a", "t:b"]["confidence"], got["t:a", "t:b"]["evidence"], got["t:a", "t:b"]["metadata"]["via"]) == (0, ["asset projection"], '["f1","f2"]')
    assert (got["t:b", "t:c"]["evidence"], got["t:b", "t:c"]["metadata"]["hops"]) == (["direct"], "0") and len(view.nodes.collect()) == 3
    hops = views.hidden_hops(view.edges, graph(spark, kinds, links).nodes).filter("source = 't:a'").orderBy("position").collect()
    assert [r["id"] for r in hops] == ["t:a", "f1", "f2", "t:b"]
    assert assets.asset_graph(graph(spark, {"f": "python_function"}, [])).edges.collect() == []


def test_identity(spark):
    n = nodes(
        spark,
        [
            ("sql_table:orders", "orders", "sql_table", {"relation_ref": "true", "table": '"orders"', "seen": "1"}), ("sql_table:mart.orders", "orders", "sql_table", {}), ("dbt_model:Orders", "Orders", "dbt_model", {"relation_name": '"db.mart.orders"', "schema": '"MART"'}),
            ("sql_table:raw.users", "users", "sql_table", {}), ("dbt_source:raw.users", "raw.users", "dbt_source", {}), ("sql_table:v", "v", "sql_table", {}), ("pipeline_dataset:v", "v", "pipeline_dataset", {"dataset_declaration": "true"}), ("sql_table:x.other", "other", "sql_table", {}),
        ],
    )
    e = edges(spark, [("sql_table:orders", "dbt_model:Orders"), ("sql_table:raw.users", "sql_table:v"), ("dbt_source:raw.users", "pipeline_dataset:v")])
    done = identity.resolve_identity(Graph(n, e))
    assert ids(done.nodes) == {"dbt_model:Orders", "dbt_source:raw.users", "pipeline_dataset:v", "sql_table:x.other"}
    merged = {r["id"]: r for r in done.nodes.collect()}["dbt_model:Orders"]
    assert merged["name"] == "Orders" and merged["metadata"]["referenced_as"] == '"orders"' and "relation_ref" not in merged["metadata"] and merged["metadata"]["seen"] == "1"
    assert {(r["source"], r["target"]) for r in done.edges.collect()} == {("dbt_source:raw.users", "pipeline_dataset:v")}


def test_views(spark):
    g = graph(spark, {"sql_table:silver.a": "sql_table", "f:b": "python_function", "x:c": "temp_view"}, [("sql_table:silver.a", "f:b"), ("f:b", "x:c")])
    assert ids(views.by_type(g, ["sql_table"]).nodes) == {"sql_table:silver.a"} and ids(views.by_type(g, ["sql_table"], "context").nodes) == {"sql_table:silver.a", "f:b"}
    assert ids(views.search(g, "B()").nodes) == {"sql_table:silver.a", "f:b", "x:c"} and ids(views.focus(g, "x:c").nodes) == ids(g.nodes)
    assert [tuple(r) for r in views.namespaces(g.nodes).collect()] == [("sql_table:silver.a", "silver", 1)]
    assert ids(views.highlight(g, "sql_table:silver.a", "impact")) == ids(g.nodes) and ids(views.highlight(g, "f:b", "upstream")) == {"f:b", "sql_table:silver.a"}
    files = spark.createDataFrame([("f.py", "\n".join(map(str, range(1, 31))))], "file_path string, content string")
    cited = spark.createDataFrame([("f.py", 2), ("f.py", 20), ("f.py", 99), ("../x", 1)], "file_path string, line_number int")
    got = {r["line_number"]: (r["first_line"], r["excerpt"].split("\n")) for r in views.excerpts(cited, files).collect()}
    assert got == {2: (1, [str(i) for i in range(1, 8)]), 20: (15, [str(i) for i in range(15, 26)])}


def test_column_order_follows_neighbours(spark):
    e = edges(spark, [("a", "y"), ("b", "x"), ("c", "z:silver.t"), ("c", "w")])
    placed = spark.createDataFrame([(i, "k", int(i not in "abc")) for i in ("a", "b", "c", "x", "y", "w", "z:silver.t")], "id string, component string, layer int")
    got = {r["id"]: r["position"] for r in traverse.column_order(placed, e).collect()}
    assert got == {"c": 0, "b": 1, "a": 2, "z:silver.t": 0, "w": 1, "x": 2, "y": 3}
    assert traverse.column_order(placed.limit(0), e).collect() == []


def test_layout_packs_components_and_single_nodes(spark):
    g = graph(spark, dict.fromkeys(["a", "b", "c", "p", "q", "s1", "s2"], "t"), [("a", "b"), ("a", "c"), ("p", "q"), ("q", "p")])
    got = {r["id"]: (r["x"], r["y"]) for r in views.layout(g).collect()}
    assert got["a"] == (0, 0) and got["b"] == (274, 0) and got["c"] == (274, 88)
    assert got["p"][0] >= 274 + 188 + 120 and got["q"][0] > got["p"][0] and got["s1"][0] == got["s2"][0] and got["s2"][1] == got["s1"][1] + 88
    assert views.pack_blocks([("a", 5000, 100), ("b", 300, 50), ("c", 300, 1700)]) == {"a": (0, 0), "b": (0, 190), "c": (0, 330)}
    assert views.layout(graph(spark, {}, [])).collect() == []


def test_long_paths_are_whole_or_an_error(spark):
    nodes = spark.createDataFrame([(c,) for c in "abcde"], "id string")
    edges = spark.createDataFrame([tuple(p) for p in ("ab", "bc", "cd", "de")], "source string, target string")
    assert inspect.signature(traverse.root_paths).parameters["max_length"].default is None
    assert [r["path"] for r in traverse.root_paths(nodes, edges, max_length=5).collect()] == [list("abcde")]
    with pytest.raises(ValueError):
        traverse.root_paths(nodes, edges, limit=None, max_length=3)


def test_every_candidate_is_reported(spark):
    nodes = spark.createDataFrame([(f"function:m{i:02}.run", "run", "function", None) for i in range(60)], "id string, name string, type string, file_path string")
    assert [n["id"] for n in resolve.candidates(nodes, "run", 3)] == [f"function:m{i:02}.run" for i in range(60)]


def test_chains_follow_the_roots_that_lead_somewhere(spark):
    g = Graph(nodes(spark, [(x, x, "t") for x in "ayz"]), edges(spark, [("y", "z"), ("z", "gone")]))
    assert render.format_chains(g) == "y\n   ↓\nz\n\na\n"
    assert render.format_chains(Graph(g.nodes.limit(0), g.edges.limit(0))) == "Graph is empty.\n"


@pytest.mark.parametrize("few", [0, 1000])
def test_a_limit_keeps_the_first_paths_of_all(spark, monkeypatch, few):
    monkeypatch.setattr(traverse, "BROADCAST_LINKS", few)
    steps = [(f"{a}{i}", f"{b}{i + 1}") for i in range(7) for a in "ab" for b in "ab"]
    g = Graph(nodes(spark, [(x, x, "t") for x in {y for s in steps for y in s}]), edges(spark, steps))
    everything = [r["path"] for r in traverse.root_paths(g.nodes, g.edges, None).collect()]
    assert len(everything) == 2**8 and everything == sorted(everything)
    assert [r["path"] for r in traverse.root_paths(g.nodes, g.edges, 5).collect()] == everything[:5]


def layers_by_hand(ids, links):
    """Longest distances over condensed components, by plain search."""
    out = {i: {b for a, b in links if a == i and b != i} for i in ids}
    reach = {}
    for i in ids:
        seen, todo = set(), [i]
        while todo:
            for b in out[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        reach[i] = seen
    strong = {i: min([i, *(j for j in reach[i] if i in reach[j])]) for i in ids}
    far = {}
    for s in set(strong.values()):
        own = {i for i in ids if strong[i] == s}
        now = {b for a in ids for b in out[a] if b in own and a not in own} or {s}
        depth = 0
        while now:
            far.update({i: depth for i in now})
            now, depth = {b for a in now for b in out[a] if b in own and b not in far}, depth + 1
    base = {s: 0 for s in strong.values()}
    for _ in ids:
        for a in ids:
            for b in out[a]:
                if strong[a] != strong[b]:
                    base[strong[b]] = max(base[strong[b]], base[strong[a]] + far[a] + 1)
    return {i: base[strong[i]] + far[i] for i in ids}


@pytest.mark.parametrize("seed", [1, 2])
def test_layers_of_cyclic_graphs(spark, seed):
    rnd = random.Random(seed)
    ids = [f"n{i:02}" for i in range(26)]
    links = {(rnd.choice(ids), rnd.choice(ids)) for _ in range(30)}
    got = {r["id"]: r["layer"] for r in traverse.layers(nodes(spark, [(i, i, "t") for i in ids]), edges(spark, sorted(links))).collect()}
    assert got == layers_by_hand(ids, links)
    got = {r["id"]: r["layer"] for r in traverse.layers(nodes(spark, [(i, i, "t") for i in "rabc"]), edges(spark, [("r", "a"), ("a", "b"), ("b", "a"), ("b", "c")])).collect()}
    assert got == {"r": 0, "a": 1, "b": 2, "c": 3}


def test_numbered_ids_are_those_of_going_through_them_in_order(spark):
    rnd = random.Random(7)
    ids = sorted({"".join(rnd.choice("ab-_.23") for _ in range(rnd.randint(1, 4))) for _ in range(150)})
    clean = {r["id"]: r["c"] for r in nodes(spark, [(i, i, "t") for i in ids]).select("id", mermaid_id(F.col("id")).alias("c")).collect()}
    used, want = set(), {}
    for i in ids:
        name, n = clean[i], 2
        while name in used:
            name, n = f"{clean[i]}_{n}", n + 1
        used.add(name)
        want[i] = name
    got = {r["id"]: r["shown"] for r in views.suffixed_ids(nodes(spark, [(i, i, "t") for i in ids]), mermaid_id(F.col("id"))).collect()}
    assert got == want


def test_running_numbers_follow_ids(spark):
    got = views.numbered(spark.createDataFrame([(f"k{i:03}",) for i in range(100)][::-1], "id string").repartition(5)).collect()
    assert sorted((r["at"], r["id"]) for r in got) == [(i, f"k{i:03}") for i in range(100)]
