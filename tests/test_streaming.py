from datetime import datetime

from weft.streaming.rescan import changed_files, latest_graph, stream_facts

SCHEMA = "repo string, path string, content string, at timestamp"


def deliver(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_facts_follow_deliveries(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    day = lambda d: datetime(2024, 1, d)
    deliver(spark, source, [("r", "a.py", "def f(spark):\n    spark.table('x').write.saveAsTable('y')\n", day(1)), ("r", "b.sql", "create table z as select * from y", day(1)), ("r", None, None, day(1))])

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        stream_facts(stream, ["repo"], "at", out, state).awaitTermination()
        graph, _ = latest_graph(spark.read.parquet(out), ["repo"])
        return {(r["source"], r["target"]) for r in graph.edges.collect()}

    assert run() == {("sql_table:x", "python_function:a.f"), ("python_function:a.f", "sql_table:y"), ("sql_table:y", "sql_table:z")}
    deliver(spark, source, [("r", "b.sql", "create table z as select * from w", day(2)), ("r", "a.py", "def f(spark):\n    spark.table('x').write.saveAsTable('y')\n", day(1))])
    assert run() == {("sql_table:x", "python_function:a.f"), ("python_function:a.f", "sql_table:y"), ("sql_table:w", "sql_table:z")}


def test_copies_are_dropped_in_tables_too(spark):
    df = spark.createDataFrame([("r", "a", "x", None), ("r", "a", "x", datetime(2024, 1, 1)), ("r", "a", None, None), ("s", "a", "x", None)], SCHEMA)
    assert changed_files(df, ["repo"], "at").count() == 3
    assert changed_files(df.limit(0), ["repo"], "at").count() == 0
