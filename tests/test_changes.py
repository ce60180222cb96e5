import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from weft.operators.changes import instant, scan_changes

SCANS = "scan_id long, repo string, project_path string, scan_timestamp string, files_scanned int, warnings array<string>, received_at timestamp"
NODES = "scan_id long, id string, name string, type string, file_path string, line_number int, metadata map<string,string>, loaded_at timestamp, snapshot string, kind string"
EDGES = "scan_id long, source string, target string, type string, confidence byte, evidence array<string>, metadata map<string,string>, loaded_at timestamp"
T = datetime(2024, 1, 1)


def scan(i, repo, ts):
    return (i, repo, "/x", ts, 1, None, T)


def node(s, i, name="n", meta=None, line=1, kind="t"):
    return (s, i, name, kind, "f.py", line, meta, T, "clash", "clash")


def edge(s, a, b, conf=1, ev=None, meta=None):
    return (s, a, b, "calls", conf, ev, meta, T)


def run(spark, scans, nodes, edges, **options):
    out = scan_changes(spark.createDataFrame(scans, SCANS), spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), **options)
    return sorted(tuple(r) for r in out.select("scan_id", "kind", "record_key", "change").collect())


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2024-04-28T13:24:48+02:00", "2024-04-28 11:24:48"), ("2024-04-28T13:24:48.5Z", "2024-04-28 13:24:48.5"), ("2024-04-28 13:24:48", "2024-04-28 13:24:48"),
        ("20240428T132448Z", "2024-04-28 13:24:48"), ("2024-04-28T13:24:48-0530", "2024-04-28 18:54:48"), ("2024-04-28t13:24+02", "2024-04-28 11:24:00"),
        ("2024-04-28", "2024-04-28 00:00:00"), ("nonsense", None), (None, None),
    ],
)
def test_instants(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string").select(instant(F.col("t")).cast("string"))
    assert df.first()[0] == want


def test_order_follows_instants_not_ids(spark):
    scans = [scan(1, "r", "2024-05-29T11:00:00Z"), scan(2, "r", "2024-05-29T12:30:00+02:00"), scan(2, "r", "2024-05-29T12:30:00+02:00")]
    got = run(spark, scans, [node(2, "a"), node(1, "b")], [])
    assert got == [(1, "node", "a", "removed"), (1, "node", "b", "added")]


def test_equal_content_in_other_order_is_no_change(spark):
    scans = [scan(1, "r", "2024-01-01T00:00:00Z"), scan(2, "r", "2024-01-02T00:00:00Z")]
    nodes = [node(1, "a", meta={"x": "1", "y": None}), node(2, "a", meta={"y": None, "x": "1"}), node(1, "e", meta=None), node(2, "e", meta={})]
    edges = [edge(1, "a", "b", ev=["p", "q", "q"]), edge(2, "a", "b", ev=["q", "p"]), edge(1, "c", "d", ev=None), edge(2, "c", "d", ev=[])]
    assert run(spark, scans, nodes, edges) == []


def test_nulls_repeats_and_strangers(spark):
    scans = [scan(1, "r", "2024-01-01T00:00:00Z"), scan(2, "r", "2024-01-02T00:00:00Z"), scan(3, "s", "2024-01-02T00:00:00Z"), scan(None, "r", None)]
    nodes = [node(1, None), node(2, None), node(9, "x"), node(2, "a"), node(2, "a"), node(1, "a", name=None), node(1, "b", line=None), node(2, "b", line=None), node(None, "z")]
    edges = [edge(1, None, "b"), edge(2, "a", None), edge(1, "k", "l", conf=None), edge(2, "k", "l", conf=0), (1, "k", "l", None, 1, None, None, T)]
    assert run(spark, scans, nodes, edges) == [
        (2, "edge", "a ->  (calls)", "added"), (2, "edge", "k -> l ()", "removed"), (2, "edge", "k -> l (calls)", "changed"), (2, "node", "a", "changed"),
    ]


def test_null_and_neighbouring_values_are_told_apart(spark):
    scans = [scan(1, "r", "2024-01-01T00:00:00Z"), scan(2, "r", "2024-01-02T00:00:00Z")]
    nodes = [(1, "a", None, "x", "f", 1, None, T, "", ""), (2, "a", "x", None, "f", 1, None, T, "", "")]
    edges = [edge(1, "a", "b", ev=["p"], meta={"q": "r"}), edge(2, "a", "b", ev=["p", "q"], meta={"r": None})]
    assert [c[3] for c in run(spark, scans, nodes, edges)] == ["changed", "changed"]


def test_a_snapshot_without_rows_removes_everything(spark):
    scans = [scan(1, "r", "2024-01-01T00:00:00Z"), scan(2, "r", "2024-01-02T00:00:00Z"), scan(3, "r", "2024-01-03T00:00:00Z")]
    assert run(spark, scans, [node(1, "a"), node(3, "a")], []) == [(2, "node", "a", "removed"), (3, "node", "a", "added")]


def test_empty_tables(spark):
    assert run(spark, [], [], []) == []
    assert run(spark, [scan(1, "r", "2024-01-01T00:00:00Z")], [], []) == []
    assert run(spark, [], [node(1, "a")], [edge(1, "a", "b")]) == []


def test_rows_are_shuffled_once(spark):
    scans = spark.createDataFrame([scan(1, "r", "2024-01-01T00:00:00Z"), scan(2, "r", "2024-01-02T00:00:00Z")], SCANS)
    out = scan_changes(scans, spark.createDataFrame([node(1, "a")], NODES), spark.createDataFrame([edge(2, "a", "b")], EDGES))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan


@pytest.mark.parametrize(("chunk_rows", "bucket_rows"), [(1, 3), (4, 10), (64, 100_000)])
def test_against_brute_force_with_a_hot_snapshot(spark, chunk_rows, bucket_rows):
    rnd = random.Random(4)
    scans, nodes, state, want = [], [], {}, []
    for s in range(1, 7):
        scans.append(scan(s, "hot", f"2024-01-0{s}T00:00:00Z"))
        new = {k: v for k, v in state.items() if rnd.random() > 0.1}
        new = {k: (v if rnd.random() > 0.1 else v + 1) for k, v in new.items()} | {f"k{rnd.randrange(400)}": 7 for _ in range(60)}
        if s > 1:
            want += [(s, "node", k, "added") for k in new.keys() - state.keys()] + [(s, "node", k, "removed") for k in state.keys() - new.keys()]
            want += [(s, "node", k, "changed") for k in new.keys() & state.keys() if new[k] != state[k]]
        nodes += [node(s, k, line=v) for k, v in new.items()]
        state = new
    assert run(spark, scans, nodes, [], chunk_rows=chunk_rows, bucket_rows=bucket_rows) == sorted(want)
