"""Queries p1, p2 and p5 and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.changes import scan_changes
from weft.operators.hierarchy import Hierarchy
from weft.operators.skew import key_profile
from weft.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added, removed and changed nodes and edges of each scan against the repository's scan before it."""
    scans, nodes, edges = (table(spark, sf_dir, t) for t in ("scans", "graph_nodes", "graph_edges"))
    return scan_changes(scans, nodes, edges)


def p1_change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes per scan and kind."""
    return p1_found(spark, sf_dir).groupBy("scan_id", "kind").agg(
        *(F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "changed"))
    )


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans, nodes, edges = (table(spark, sf_dir, t) for t in ("scans", "graph_nodes", "graph_edges"))
    by_source = key_profile(edges, scans, key="source", join_key="scan_id", value="target")
    by_type = key_profile(nodes, scans, key="type", join_key="scan_id", value="id")
    return by_source.withColumn("field", F.lit("edge_source")).unionByName(by_type.withColumn("field", F.lit("node_type")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys with at least 4 % of the rows of their table."""
    return _profiles(spark, sf_dir).filter("heavy").select("field", "key_value")


def p2_key_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, rows joined to scan headers, distinct scans and distinct targets or ids of every key."""
    return _profiles(spark, sf_dir).select(
        "field", "key_value", "rows", "joined_rows", F.col("join_keys").alias("scans"),
        F.col("matched_join_keys").alias("known_scans"), "values", "heavy",
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root and depth of every asset; depth -1 on or below a cycle."""
    return Hierarchy(table(spark, sf_dir, "asset_edges"), "source", "target").nodes().select("node_id", "root_id", "depth")


def p5_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path, depth, root and number of descendants of every asset outside cycles."""
    tree = Hierarchy(table(spark, sf_dir, "asset_edges"), "source", "target")
    placed = tree.nodes().filter("depth >= 0").select("node_id", "root_id", "depth", "descendants")
    return placed.join(tree.paths(), "node_id")


def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All descendants of the parents of links whose ``edge_id`` is divisible by 50: a sample of ``p5_all_descendants``."""
    links = table(spark, sf_dir, "asset_edges")
    asked = links.filter("edge_id % 50 = 0").select(F.regexp_replace("source", r"(?U)^\s+|\s+$", "").alias("node_id"))
    return Hierarchy(links, "source", "target").descendants(asked)


def p5_all_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All descendants of every asset outside cycles."""
    return Hierarchy(table(spark, sf_dir, "asset_edges"), "source", "target").descendants()


def p5_other_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to a child that has a smaller parent, which the hierarchy leaves out."""
    return Hierarchy(table(spark, sf_dir, "asset_edges"), "source", "target").other_parents()


QUERIES = {f.__name__: f for f in (p1_found, p1_change_counts, p2_found, p2_key_profile, p5_found, p5_hierarchy, p5_descendants, p5_all_descendants, p5_other_parents)}

_SNAPSHOTS = """
headers AS (SELECT scan_id, any_value(repo) AS repo, any_value(scan_timestamp)::TIMESTAMPTZ AS instant FROM scans GROUP BY scan_id),
pairs AS (SELECT scan_id, lag(scan_id) OVER (PARTITION BY repo ORDER BY instant, scan_id) AS earlier FROM headers),
raw_records AS (
  SELECT scan_id, 'node' AS kind, id AS record_key,
    coalesce(name, '~') || '|' || coalesce(type, '~') || '|' || coalesce(file_path, '~') || '|' || coalesce(line_number::VARCHAR, '~') || '|'
    || coalesce(list_sort(list_transform(map_entries(metadata), lambda e: e.key || '=' || coalesce(e.value, '~')))::VARCHAR, '[]') AS content
  FROM graph_nodes WHERE id IS NOT NULL
  UNION SELECT scan_id, 'edge', source || ' -> ' || target || ' (' || type || ')',
    coalesce(confidence::VARCHAR, '~') || '|' || coalesce(list_sort(list_distinct(evidence))::VARCHAR, '[]') || '|'
    || coalesce(list_sort(list_transform(map_entries(metadata), lambda e: e.key || '=' || coalesce(e.value, '~')))::VARCHAR, '[]')
  FROM graph_edges WHERE source IS NOT NULL),
now_rows AS (SELECT p.scan_id, r.kind, r.record_key, r.content FROM pairs p JOIN raw_records r USING (scan_id) WHERE p.earlier IS NOT NULL),
was_rows AS (SELECT p.scan_id, r.kind, r.record_key, r.content FROM pairs p JOIN raw_records r ON r.scan_id = p.earlier),
changes AS (
  SELECT coalesce(n.scan_id, w.scan_id) AS scan_id, coalesce(n.kind, w.kind) AS kind, coalesce(n.record_key, w.record_key) AS record_key,
    CASE WHEN w.scan_id IS NULL THEN 'added' WHEN n.scan_id IS NULL THEN 'removed' ELSE 'changed' END AS change
  FROM now_rows n FULL JOIN was_rows w ON n.scan_id = w.scan_id AND n.kind = w.kind AND n.record_key = w.record_key
  WHERE n.content IS DISTINCT FROM w.content)
"""

_PROFILES = """
hdr AS (SELECT scan_id, count(*) AS m FROM scans GROUP BY scan_id),
profiles AS (
  SELECT 'edge_source' AS field, source AS key_value, count(*) AS rows, coalesce(sum(m), 0)::BIGINT AS joined_rows, count(DISTINCT e.scan_id) AS scans,
    count(DISTINCT hdr.scan_id) AS known_scans, count(DISTINCT target) AS "values", count(*) >= 0.04 * (SELECT count(source) FROM graph_edges) AS heavy
  FROM graph_edges e LEFT JOIN hdr USING (scan_id) WHERE source IS NOT NULL GROUP BY source
  UNION ALL SELECT 'node_type', type, count(*), coalesce(sum(m), 0)::BIGINT, count(DISTINCT n.scan_id), count(DISTINCT hdr.scan_id), count(DISTINCT id),
    count(*) >= 0.04 * (SELECT count(type) FROM graph_nodes)
  FROM graph_nodes n LEFT JOIN hdr USING (scan_id) WHERE type IS NOT NULL GROUP BY type)
"""

_TREES = r"""
ends AS (SELECT edge_id, nullif(regexp_replace(source, '^\s+|\s+$', '', 'g'), '') AS p, nullif(regexp_replace(target, '^\s+|\s+$', '', 'g'), '') AS c FROM asset_edges),
names AS (SELECT p AS v FROM ends WHERE p IS NOT NULL UNION SELECT c FROM ends WHERE c IS NOT NULL),
parents AS (SELECT c AS v, min(p) AS p FROM ends WHERE p IS NOT NULL AND c IS NOT NULL GROUP BY c),
placed(v, root, depth, path) AS (
  SELECT v, v, 0::BIGINT, v FROM names WHERE v NOT IN (SELECT v FROM parents)
  UNION ALL SELECT c.v, t.root, t.depth + 1, t.path || ' > ' || c.v FROM placed t JOIN parents c ON c.p = t.v),
lost AS (SELECT * FROM parents WHERE v NOT IN (SELECT v FROM placed)),
reach(v, up) AS (SELECT v, p FROM lost UNION SELECT r.v, l.p FROM reach r JOIN lost l ON l.v = r.up),
labels AS (SELECT r.v, min(r.up) AS root FROM reach r WHERE EXISTS (SELECT 1 FROM reach s WHERE s.v = r.up AND s.up = r.up) GROUP BY r.v)
"""

ORACLE = {
    "p1_found": f"WITH {_SNAPSHOTS} SELECT scan_id, kind, record_key, change FROM changes",
    "p1_change_counts": f"WITH {_SNAPSHOTS} SELECT scan_id, kind, " + ", ".join(f"count(*) FILTER (change = '{c}') AS {c}" for c in ("added", "removed", "changed")) + " FROM changes GROUP BY scan_id, kind",
    "p2_found": f"WITH {_PROFILES} SELECT field, key_value FROM profiles WHERE heavy",
    "p2_key_profile": f"WITH {_PROFILES} SELECT * FROM profiles",
    "p5_found": f"WITH RECURSIVE {_TREES} SELECT v AS node_id, root AS root_id, depth FROM placed UNION ALL SELECT v, root, -1 FROM labels",
    "p5_hierarchy": f"WITH RECURSIVE {_TREES}, above(v, a) AS (SELECT v, p FROM parents UNION SELECT x.v, y.p FROM above x JOIN parents y ON y.v = x.a), "
    "sizes AS (SELECT a AS v, count(*) AS n FROM above GROUP BY a) "
    "SELECT placed.v AS node_id, root AS root_id, depth, coalesce(n, 0)::BIGINT AS descendants, path FROM placed LEFT JOIN sizes USING (v)",
    "p5_descendants": f"WITH RECURSIVE {_TREES}, asked AS (SELECT DISTINCT p AS v FROM ends WHERE edge_id % 50 = 0 AND p IN (SELECT v FROM placed)), "
    "below(a, v) AS (SELECT q.v, c.v FROM asked q JOIN parents c ON c.p = q.v UNION SELECT b.a, c.v FROM below b JOIN parents c ON c.p = b.v) "
    "SELECT a AS ancestor_id, v AS node_id FROM below",
    "p5_other_parents": f"WITH RECURSIVE {_TREES} SELECT DISTINCT c AS node_id, e.p AS parent_id, parents.p AS kept_id FROM ends e JOIN parents ON v = c WHERE e.p IS NOT NULL AND e.p <> parents.p",
    "p5_all_descendants": f"WITH RECURSIVE {_TREES}, below(a, v) AS (SELECT p, v FROM parents WHERE v IN (SELECT v FROM placed) "
    "UNION SELECT b.a, c.v FROM below b JOIN parents c ON c.p = b.v) SELECT a AS ancestor_id, v AS node_id FROM below",
}
