"""Graphs derived from the tables, on which the graph operators are shown; each has the same definition in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.operators.model import Graph
from weft.session import table


def _id(kind: str, key: str) -> Column:
    return F.concat(F.lit(kind + ":"), F.col(key).cast("string"))


def fk_graph(spark: SparkSession, sf: str, raw: bool = False) -> Graph:
    """Rows as nodes and references as edges: region, nation, customer and supplier, part, orders. ``raw`` keeps repeats."""
    t = {n: table(spark, sf, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    named = [
        ("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("customer", "c_custkey", "c_name"),
        ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name"), ("orders", "o_orderkey", "o_orderpriority"),
    ]
    nodes = None
    for kind, key, name in named:
        part = t[kind].select(_id(kind, key).alias("id"), F.col(name).alias("name"), F.lit(kind).alias("type"))
        nodes = part if nodes is None else nodes.unionByName(part)
    empty_map = F.create_map().cast("map<string,string>")
    nodes = nodes.select("*", F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("int").alias("line_number"), empty_map.alias("metadata"))

    def link(df: DataFrame, source: Column, target: Column, confidence: Column = F.lit(2), evidence: Column | None = None) -> DataFrame:
        return df.select(
            source.alias("source"), target.alias("target"), F.lit("feeds").alias("type"), confidence.cast("tinyint").alias("confidence"),
            (F.array(evidence) if evidence is not None else F.array().cast("array<string>")).alias("evidence"), empty_map.alias("metadata"),
        )

    strength, flag = F.when(F.col("l_linestatus") == "F", 2).otherwise(1), F.col("l_returnflag")
    parts = [
        link(t["nation"], _id("region", "n_regionkey"), _id("nation", "n_nationkey")),
        link(t["customer"], _id("nation", "c_nationkey"), _id("customer", "c_custkey")),
        link(t["supplier"], _id("nation", "s_nationkey"), _id("supplier", "s_suppkey")),
        link(t["orders"], _id("customer", "o_custkey"), _id("orders", "o_orderkey")),
        link(t["lineitem"], _id("part", "l_partkey"), _id("orders", "l_orderkey"), strength, flag),
        link(t["lineitem"], _id("supplier", "l_suppkey"), _id("orders", "l_orderkey"), strength, flag),
    ]
    edges = parts[0]
    for p in parts[1:]:
        edges = edges.unionByName(p)
    return Graph(nodes, edges if raw else edges.dropDuplicates(["source", "target", "type"]))


FK_SQL = """
fk_nodes AS (
  SELECT 'region:' || r_regionkey AS id, r_name AS name, 'region' AS type FROM region UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'nation' FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, c_name, 'customer' FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'supplier' FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, p_name, 'part' FROM part UNION ALL SELECT 'orders:' || o_orderkey, o_orderpriority, 'orders' FROM orders),
fk_raw AS (
  SELECT 'region:' || n_regionkey AS source, 'nation:' || n_nationkey AS target, 2 AS confidence, NULL AS evidence FROM nation
  UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 2, NULL FROM customer UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 2, NULL FROM supplier
  UNION ALL SELECT 'customer:' || o_custkey, 'orders:' || o_orderkey, 2, NULL FROM orders
  UNION ALL SELECT 'part:' || l_partkey, 'orders:' || l_orderkey, CASE WHEN l_linestatus = 'F' THEN 2 ELSE 1 END, l_returnflag FROM lineitem
  UNION ALL SELECT 'supplier:' || l_suppkey, 'orders:' || l_orderkey, CASE WHEN l_linestatus = 'F' THEN 2 ELSE 1 END, l_returnflag FROM lineitem),
fk AS (SELECT DISTINCT source, target FROM fk_raw)
"""


def journey_graph(spark: SparkSession, sf: str) -> Graph:
    """Cyclic: per user in the order of time, the key of an event's properties to that of the next event."""
    k = F.concat(F.lit("k:"), F.get_json_object("props", "$.k"))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = table(spark, sf, "events").select("user_id", "ts", "event_id", k.alias("source")).withColumn("target", F.lead("source").over(order))
    edges = steps.filter("source is not null and target is not null").select("source", "target", F.lit("next").alias("type")).distinct()
    ids = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return Graph(ids.select("id", F.col("id").alias("name"), F.lit("step").alias("type")), edges)


JOURNEY_SQL = """
steps AS (SELECT 'k:' || json_extract_string(props, '$.k') AS source, user_id, ts, event_id FROM events),
journey AS (SELECT DISTINCT source, target FROM (SELECT source, lead(source) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM steps) WHERE source IS NOT NULL AND target IS NOT NULL)
"""


def typed_graph(spark: SparkSession, sf: str) -> Graph:
    """The references without parts, with types of all classes: code, bridges and anchors."""
    fk = fk_graph(spark, sf)
    orders = table(spark, sf, "orders").select(
        _id("orders", "o_orderkey").alias("oid"),
        F.when(F.col("o_orderkey") % 100 == 0, "sql_table").when(F.col("o_orderstatus") == "P", "temp_view").otherwise("python_function").alias("otype"),
    )
    kinds = F.create_map(*(F.lit(x) for x in ("region", "python_module", "nation", "python_function", "customer", "python_function", "supplier", "api_route")))
    nodes = fk.nodes.filter("type <> 'part'").join(orders, F.col("id") == F.col("oid"), "left").select(
        "id", "name", F.coalesce("otype", kinds[F.col("type")]).alias("type"), "file_path", "line_number", "metadata"
    )
    return Graph(nodes, fk.edges.filter("source not like 'part:%' and source not like 'supplier:%'"))


TYPED_SQL = f"""
{FK_SQL},
typed AS (
  SELECT id, name, CASE type WHEN 'region' THEN 'python_module' WHEN 'supplier' THEN 'api_route' WHEN 'orders' THEN
    CASE WHEN o_orderkey % 100 = 0 THEN 'sql_table' WHEN o_orderstatus = 'P' THEN 'temp_view' ELSE 'python_function' END ELSE 'python_function' END AS type
  FROM fk_nodes LEFT JOIN orders ON id = 'orders:' || o_orderkey WHERE fk_nodes.type <> 'part'),
tedges AS (SELECT * FROM fk WHERE source NOT LIKE 'part:%' AND source NOT LIKE 'supplier:%')
"""


def asset_test_graph(spark: SparkSession, sf: str) -> Graph:
    """region, nation, supplier, brand and return flag in a row; the first and the last are assets."""
    fk = fk_graph(spark, sf)
    brands = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        _id("supplier", "l_suppkey").alias("s"), F.concat(F.lit("brand:"), "p_brand").alias("b"), F.concat(F.lit("flag:"), "l_returnflag").alias("f"),
        F.when(F.col("l_linestatus") == "F", 2).otherwise(1).alias("c"),
    )
    none = F.array().cast("array<string>")
    link = lambda df, a, b: df.groupBy(F.col(a).alias("source"), F.col(b).alias("target")).agg(F.min("c").cast("tinyint").alias("confidence"))
    first = fk.edges.filter("source like 'region:%' or target like 'supplier:%'").select("source", "target", "confidence")
    edges = first.unionByName(link(brands, "s", "b")).unionByName(link(brands, "b", "f"))
    edges = edges.select("source", "target", F.lit("feeds").alias("type"), "confidence", none.alias("evidence"), F.create_map().cast("map<string,string>").alias("metadata"))
    kinds = F.create_map(*(F.lit(x) for x in ("region", "sql_table", "nation", "python_function", "supplier", "temp_view", "brand", "python_function", "flag", "sql_table")))
    ids = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    nodes = ids.select(
        "id", F.col("id").alias("name"), kinds[F.substring_index("id", ":", 1)].alias("type"), F.lit(None).cast("string").alias("file_path"),
        F.lit(None).cast("int").alias("line_number"), F.create_map().cast("map<string,string>").alias("metadata"),
    )
    return Graph(nodes, edges)


ASSET_SQL = f"""
{FK_SQL},
brands AS (SELECT 'supplier:' || l_suppkey AS s, 'brand:' || p_brand AS b, 'flag:' || l_returnflag AS f, CASE WHEN l_linestatus = 'F' THEN 2 ELSE 1 END AS c FROM lineitem JOIN part ON l_partkey = p_partkey),
ae AS (
  SELECT source, target, 2 AS c FROM fk WHERE source LIKE 'region:%' OR target LIKE 'supplier:%'
  UNION ALL SELECT s, b, min(c) FROM brands GROUP BY ALL UNION ALL SELECT b, f, min(c) FROM brands GROUP BY ALL),
l2 AS (SELECT x.source AS start, y.target AS cur, [x.target, y.target] AS via FROM ae x JOIN ae y ON y.source = x.target WHERE x.source LIKE 'region:%' AND y.target LIKE 'supplier:%'),
l3 AS (SELECT *, row_number() OVER (PARTITION BY start, cur ORDER BY via) AS n FROM (SELECT start, z.target AS cur, list_append(via, z.target) AS via FROM l2 JOIN ae z ON z.source = l2.cur)),
paths AS (
  SELECT source, target, via, row_number() OVER (PARTITION BY source, target ORDER BY len(via), via) AS place
  FROM (SELECT start AS source, w.target AS target, via FROM l3 JOIN ae w ON w.source = l3.cur WHERE n <= 8))
"""


def latest_graph(spark: SparkSession, sf: str) -> Graph:
    """Nodes and edges of each repository's last scan, as delivered."""
    from weft.operators.changes import consecutive, instant

    scans = consecutive(table(spark, sf, "scans"), "scan_id", "repo", instant(F.col("scan_timestamp")), "received_at")
    last = scans.filter("later is null").select(F.col("snapshot").alias("scan_id"))
    nodes = table(spark, sf, "graph_nodes").join(last, "scan_id", "left_semi").drop("scan_id", "loaded_at")
    edges = table(spark, sf, "graph_edges").join(last, "scan_id", "left_semi").drop("scan_id", "loaded_at")
    return Graph(nodes.filter("id is not null"), edges.filter("source is not null"))


LATEST_SQL = """
last_scans AS (SELECT arg_max(scan_id, (scan_timestamp::TIMESTAMPTZ, scan_id)) AS scan_id FROM scans GROUP BY repo),
ln AS (SELECT * FROM graph_nodes WHERE scan_id IN (SELECT scan_id FROM last_scans) AND id IS NOT NULL),
le AS (SELECT * FROM graph_edges WHERE scan_id IN (SELECT scan_id FROM last_scans) AND source IS NOT NULL)
"""
