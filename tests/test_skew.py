from collections import Counter

from pyspark.sql import functions as F

from weft.operators.skew import compact_states, join_counts, key_profile
from weft.plans.training_queries import p2_found


def test_counts_equal_the_plain_join(spark):
    left = [(i % 3, "hot" if i % 3 else f"k{i % 5}", i) for i in range(90)] + [(None, "hot", 1), (7, None, 1), (7, "x", 2)]
    right = [(0, "a"), (0, "b"), (1, "c"), (None, "d")]
    a, b = spark.createDataFrame(left, "j int, g string, v int"), spark.createDataFrame(right, "j int, w string")
    got = {r["key"]: (r["rows"], r["joined_rows"], r["join_keys"], r["matched_join_keys"]) for r in join_counts(compact_states(a, "g", "j", "v"), b, "j").collect()}
    rows, joined, keys, matched = Counter(), Counter(), {}, {}
    for j, g, _ in left:
        if g is None:
            continue
        rows[g] += 1
        joined[g] += sum(j is not None and j == x for x, _ in right)
        keys.setdefault(g, set()).update({j} - {None})
        matched.setdefault(g, set()).update({j} & {0, 1})
    assert got == {g: (rows[g], joined[g], len(keys[g]), len(matched[g])) for g in rows}


def test_distinct_values_skip_nulls_and_repeats(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", None), ("b", None), (None, 3)], "g string, v int")
    spread = compact_states(df.withColumn("j", F.lit(None).cast("int")), "g", "j", "v").filter("by_value").groupBy("key").agg(F.count("value"))
    assert {tuple(r) for r in spread.collect()} == {("a", 1), ("b", 0)}


def test_heavy_keys_count_rows_as_delivered(spark):
    rows = [("h", 1, i % 2) for i in range(4)] + [(f"k{i}", 2, i) for i in range(96)] + [(None, 1, 1)] * 50
    df = spark.createDataFrame(rows, "key string, s int, v int")
    got = key_profile(df, spark.createDataFrame([(1,), (1,)], "s int"), key="key", join_key="s", value="v").collect()
    heavy = [r for r in got if r["heavy"]]
    assert [(r["key_value"], r["rows"], r["joined_rows"], r["values"], r["share"]) for r in heavy] == [("h", 4, 8, 2, 0.04)]
    assert len(got) == 97


def test_empty(spark):
    df = spark.createDataFrame([], "key string, s int, v int")
    assert key_profile(df, df.select("s"), key="key", join_key="s", value="v").collect() == []
    nulls = spark.createDataFrame([(None, 1, 1)], "key string, s int, v int")
    assert key_profile(nulls, nulls.select("s"), key="key", join_key="s", value="v").collect() == []


def test_heavy_keys_come_from_the_joined_states(spark, tmp_path):
    spark.createDataFrame([(1,)], "scan_id long").write.parquet(str(tmp_path / "scans.parquet"))
    spark.createDataFrame([(1, "n", "t")], "scan_id long, id string, type string").write.parquet(str(tmp_path / "graph_nodes.parquet"))
    spark.createDataFrame([(1, "a", "b")] * 30 + [(2, "c", None)], "scan_id long, source string, target string").write.parquet(str(tmp_path / "graph_edges.parquet"))
    assert {tuple(r) for r in p2_found(spark, str(tmp_path)).collect()} == {("edge_source", "a"), ("node_type", "t")}
