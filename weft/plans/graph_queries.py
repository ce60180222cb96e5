"""Queries of the graph operators over derived and delivered graphs, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import ids
from weft.operators import assets, identity, model, render, resolve, scope, traverse, views
from weft.operators.changes import map_entries_set
from weft.operators.model import Graph
from weft.plans.derived_graphs import (
    ASSET_SQL, FK_SQL, JOURNEY_SQL, LATEST_SQL, TYPED_SQL, asset_test_graph, fk_graph, journey_graph, latest_graph, typed_graph,
)
from weft.session import table
from weft.sources import store
from weft.sources.repository import extract_facts, fact_edges, fact_nodes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _start(spark: SparkSession, *names: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "id string")


def _map_text(column: str = "metadata"):
    """A map as text with its keys in order."""
    return F.array_join(F.transform(map_entries_set(F.col(column)), lambda e: F.concat(e["k"], F.lit("="), F.coalesce(e["v"], F.lit("~")))), ",")


def _walk_sql(start: str, forward: bool = True, limit: int = 8) -> str:
    a, b = ("source", "target") if forward else ("target", "source")
    return f"w(id, depth) AS (SELECT '{start}', 0 UNION SELECT f.{b}, depth + 1 FROM w JOIN fk f ON f.{a} = w.id WHERE depth < {limit})"


# walks

@query(f"WITH RECURSIVE {FK_SQL}, {_walk_sql('region:0')} SELECT id, name, type, min(depth)::INT AS depth FROM w JOIN fk_nodes USING (id) WHERE depth > 0 GROUP BY ALL")
def impact_fk(spark, sf):
    """Everything that depends on a region, with its distance."""
    g = fk_graph(spark, sf)
    return traverse.impact(g.nodes, g.edges, "region:0")


@query(f"WITH RECURSIVE {FK_SQL}, {_walk_sql('region:0', limit=2)} SELECT id, name, type, min(depth)::INT AS depth FROM w JOIN fk_nodes USING (id) WHERE depth > 0 GROUP BY ALL")
def impact_fk_depth2(spark, sf):
    """The same within two steps."""
    g = fk_graph(spark, sf)
    return traverse.impact(g.nodes, g.edges, "region:0", 2)


@query(f"WITH RECURSIVE {FK_SQL}, {_walk_sql('region:0')}, d AS (SELECT id, min(depth) AS depth FROM w WHERE depth > 0 GROUP BY id) "
       "SELECT count(*) AS affected, count(*) FILTER (depth = 1) AS direct, count(*) FILTER (depth >= 2) AS transitive FROM d")
def impact_summary(spark, sf):
    """How many nodes depend on a region directly and transitively."""
    g = fk_graph(spark, sf)
    return traverse.impact_summary(traverse.impact(g.nodes, g.edges, "region:0"))


@query(f"WITH {FK_SQL} SELECT target AS id FROM fk WHERE source = 'nation:3'")
def direct_downstream(spark, sf):
    """What depends on a nation directly."""
    return traverse.neighbours(fk_graph(spark, sf).edges, "nation:3")


@query(f"WITH {FK_SQL} SELECT source AS id FROM fk WHERE target = 'orders:10'")
def direct_upstream(spark, sf):
    """What an order depends on directly."""
    return traverse.neighbours(fk_graph(spark, sf).edges, "orders:10", forward=False)


@query(f"WITH RECURSIVE {FK_SQL}, {_walk_sql('nation:3')} SELECT id, min(depth)::INT AS depth FROM w WHERE depth > 0 GROUP BY id")
def descendants(spark, sf):
    """All that depends on a nation."""
    return traverse.walk(fk_graph(spark, sf).edges, _start(spark, "nation:3")).select("id", "depth")


@query(f"WITH RECURSIVE {FK_SQL}, {_walk_sql('orders:10', False)} SELECT id, min(depth)::INT AS depth FROM w WHERE depth > 0 GROUP BY id")
def ancestors(spark, sf):
    """All that an order depends on."""
    return traverse.walk(fk_graph(spark, sf).edges, _start(spark, "orders:10"), forward=False).select("id", "depth")


@query(f"WITH RECURSIVE {JOURNEY_SQL}, r(id) AS (SELECT 'k:0' UNION SELECT target FROM r JOIN journey ON source = id) SELECT id FROM r")
def reachable_cyclic(spark, sf):
    """The nodes that a node of a cyclic graph reaches."""
    return traverse.reachable(journey_graph(spark, sf).edges, _start(spark, "k:0"))


@query(f"WITH RECURSIVE {FK_SQL}, kept AS (SELECT id FROM fk_nodes WHERE type IN ('region', 'customer')), f(id) AS (SELECT id FROM kept UNION SELECT target FROM f JOIN fk ON source = id), "
       "b(id) AS (SELECT id FROM kept UNION SELECT source FROM b JOIN fk ON target = id) SELECT id FROM f INTERSECT SELECT id FROM b")
def directed_connectors(spark, sf):
    """Nodes on directed paths between regions and customers."""
    g = fk_graph(spark, sf)
    return traverse.connectors(g.edges, g.nodes.filter("type in ('region', 'customer')").select("id"))


# merges

_ENTRIES = """CASE WHEN v = 'true' THEN 'True' WHEN v = 'false' THEN 'False' ELSE regexp_replace(v, '^"|"$', '', 'g') END AS s"""
_MERGED = """
long_{n} AS (SELECT {k}, e.key AS key, e.value AS v FROM (SELECT {k}, unnest(map_entries(metadata)) AS e FROM {t}) WHERE e.value IS NOT NULL AND e.value NOT IN ('', '""', 'null')),
best_{n} AS (SELECT {k}, key, min({{'s': s, 'v': v}}).v AS v FROM (SELECT *, {entries} FROM long_{n}) GROUP BY {k}, key),
meta_{n} AS (SELECT {k}, string_agg(key || '=' || v, ',' ORDER BY key) AS metadata FROM best_{n} GROUP BY {k})"""


def _merged(n: str, t: str, k: str) -> str:
    return _MERGED.format(n=n, t=t, k=k, entries=_ENTRIES)


@query(f"WITH gn AS (SELECT * FROM graph_nodes WHERE id IS NOT NULL), {_merged('n', 'gn', 'id')} SELECT id, min(nullif(name, '')) AS name, min(nullif(type, '')) AS type, min(nullif(file_path, '')) AS file_path, "
       "min(line_number) AS line_number, coalesce(any_value(m.metadata), '') AS metadata FROM gn LEFT JOIN meta_n m USING (id) GROUP BY id")
def node_merge(spark, sf):
    """One node per id from all deliveries."""
    return model.merge_nodes(table(spark, sf, "graph_nodes").drop("scan_id", "loaded_at")).select("id", "name", "type", "file_path", "line_number", _map_text().alias("metadata"))


@query(f"WITH {FK_SQL} SELECT source, target, 'feeds' AS type, max(confidence)::INT AS confidence, coalesce(array_to_string(list_sort(list_distinct(list(evidence))), '|'), '') AS evidence FROM fk_raw GROUP BY source, target")
def edge_merge(spark, sf):
    """One edge per source, target and type from repeated references."""
    merged = model.merge_edges(fk_graph(spark, sf, raw=True).edges)
    return merged.select("source", "target", "type", F.col("confidence").cast("int").alias("confidence"), F.array_join("evidence", "|").alias("evidence"))


@query(f"WITH ge AS (SELECT * FROM graph_edges WHERE source IS NOT NULL), {_merged('e', 'ge', 'source, target, type')}, ev AS (SELECT source, target, type, unnest(evidence) AS t FROM ge), "
       "tokens AS (SELECT source, target, type, string_agg(DISTINCT t, '|' ORDER BY t) AS evidence FROM ev GROUP BY ALL) "
       "SELECT source, target, type, max(coalesce(confidence, 0))::INT AS confidence, coalesce(any_value(tokens.evidence), '') AS evidence, coalesce(any_value(m.metadata), '') AS metadata "
       "FROM ge LEFT JOIN meta_e m USING (source, target, type) LEFT JOIN tokens USING (source, target, type) GROUP BY source, target, type")
def edge_merge_scanned(spark, sf):
    """One edge per key from all deliveries, with merged evidence and metadata."""
    merged = model.merge_edges(table(spark, sf, "graph_edges").drop("scan_id", "loaded_at"))
    return merged.select("source", "target", "type", F.col("confidence").cast("int").alias("confidence"), F.array_join("evidence", "|").alias("evidence"), _map_text().alias("metadata"))


@query(f"WITH nf AS (SELECT * FROM node_facts WHERE id IS NOT NULL), {_merged('f', 'nf', 'repo, id')} SELECT * FROM meta_f")
def metadata_merge(spark, sf):
    """Merged metadata of all facts with the same id."""
    merged = model.merge_metadata(table(spark, sf, "node_facts").filter("id is not null"), ["repo", "id"])
    return merged.select("repo", "id", _map_text().alias("metadata"))


_BUILT = f"""{LATEST_SQL},
mn AS (SELECT id, min(nullif(name, '')) AS name, min(nullif(type, '')) AS type, min(nullif(file_path, '')) AS file_path FROM ln GROUP BY id), {_merged('l', 'ln', 'id')},
gone AS (SELECT id FROM mn LEFT JOIN meta_l USING (id) WHERE type = 'python_module' AND coalesce(file_path, '') = '' AND ',' || metadata || ',' LIKE '%,imported=true,%'),
bn AS (SELECT * FROM mn WHERE id NOT IN (SELECT id FROM gone)), {_merged('x', 'le', 'source, target, type')},
me AS (SELECT DISTINCT source, target, type FROM le WHERE source NOT IN (SELECT id FROM gone) AND target NOT IN (SELECT id FROM gone)),
be AS (SELECT * FROM me WHERE source IN (SELECT id FROM bn) AND target IN (SELECT id FROM bn))"""


@query(f"WITH {_BUILT} SELECT source, target, type FROM be")
def dangling_drop(spark, sf):
    """Edges of the last scans whose two ends are known."""
    g = latest_graph(spark, sf)
    return model.build_graph(g.nodes, g.edges)[0].edges.select("source", "target", "type")


@query(f"WITH {_BUILT} SELECT 'Dropped dangling edge ' || source || ' -> ' || target || ' (' || type || ')' AS message FROM me LEFT JOIN meta_x USING (source, target, type) "
       "WHERE (source NOT IN (SELECT id FROM bn) OR target NOT IN (SELECT id FROM bn)) AND ',' || coalesce(metadata, '') || ',' NOT LIKE '%,provisional=true,%'")
def dangling_warn(spark, sf):
    """Warnings about edges with an unknown end."""
    g = latest_graph(spark, sf)
    return model.build_graph(g.nodes, g.edges)[1]


@query(f"WITH {_BUILT} SELECT id FROM gone")
def unresolved_imports(spark, sf):
    """Modules that were imported but not scanned."""
    nodes = model.merge_nodes(latest_graph(spark, sf).nodes)
    return nodes.filter(model.unresolved_import(nodes)).select("id")


@query("SELECT p_name AS key, min(p_brand) AS id FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) = 1")
def ambiguous_names(spark, sf):
    """Names that only one brand claims."""
    return identity._unique(table(spark, sf, "part").select(F.col("p_name").alias("key"), F.col("p_brand").alias("id")))


def _declared(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    name = F.lower(F.concat(F.translate("p_brand", "#", "_"), F.lit("."), F.translate("p_name", " ", "_")))
    bare = F.lower(F.concat(F.translate("p_name", " ", "_"), F.lit("_"), F.col("p_size").cast("string")))
    quoted = F.concat(F.lit('"'), F.translate("p_brand", "#", "_"), F.lit("."), F.upper(F.translate("p_name", " ", "_")), F.lit('"'))
    empty = F.create_map().cast("map<string,string>")
    parts = [
        part.select(F.concat(F.lit("sql_table:"), name).alias("id"), F.lit("sql_table").alias("type"), empty.alias("metadata")),
        part.select(F.concat(F.lit("sql_table:"), bare).alias("id"), F.lit("sql_table").alias("type"), empty.alias("metadata")),
        part.filter("p_size < 5").select(F.concat(F.lit("pipeline_dataset:"), name).alias("id"), F.lit("pipeline_dataset").alias("type"), F.create_map(F.lit("dataset_declaration"), F.lit("true")).alias("metadata")),
        part.filter("p_size between 5 and 15").select(F.concat(F.lit("dbt_source:"), name).alias("id"), F.lit("dbt_source").alias("type"), empty.alias("metadata")),
        part.filter("p_size between 10 and 30").select(F.concat(F.lit("dbt_model:m"), "p_partkey").alias("id"), F.lit("dbt_model").alias("type"), F.create_map(F.lit("relation_name"), quoted).alias("metadata")),
        part.filter("p_size > 30").select(F.concat(F.lit("dbt_model:"), bare).alias("id"), F.lit("dbt_model").alias("type"), empty.alias("metadata")),
    ]
    nodes = parts[0]
    for p in parts[1:]:
        nodes = nodes.unionByName(p)
    return nodes.dropDuplicates(["id"]).withColumn("name", F.regexp_replace("id", "^[^:]*:", ""))


@query("WITH p AS (SELECT *, lower(replace(p_brand, '#', '_') || '.' || replace(p_name, ' ', '_')) AS q, lower(replace(p_name, ' ', '_')) || '_' || p_size AS b FROM part), "
       "refs AS (SELECT DISTINCT q AS k FROM p UNION SELECT b FROM p), ds AS (SELECT DISTINCT q AS k, 'pipeline_dataset:' || q AS id FROM p WHERE p_size < 5), "
       "rel AS (SELECT q AS k, 'dbt_model:' || min('m' || p_partkey) AS id FROM p WHERE p_size BETWEEN 10 AND 30 GROUP BY q HAVING count(*) = 1), "
       "src AS (SELECT DISTINCT q AS k, 'dbt_source:' || q AS id FROM p WHERE p_size BETWEEN 5 AND 15), mo AS (SELECT DISTINCT b AS k, 'dbt_model:' || b AS id FROM p WHERE p_size > 30) "
       "SELECT 'sql_table:' || k AS id, coalesce(ds.id, rel.id, src.id, CASE WHEN k NOT LIKE '%.%' THEN mo.id END) AS canonical FROM refs LEFT JOIN ds USING (k) LEFT JOIN rel USING (k) LEFT JOIN src USING (k) LEFT JOIN mo USING (k) "
       "WHERE coalesce(ds.id, rel.id, src.id, CASE WHEN k NOT LIKE '%.%' THEN mo.id END) IS NOT NULL")
def identity_resolve(spark, sf):
    """Tables that stand for a declared dataset, and which."""
    return identity.rewrites(_declared(spark, sf))


@query(f"WITH {LATEST_SQL}, n AS (SELECT id, min(name) AS name, regexp_replace(id, '^[^:]*:', '') AS ident, regexp_extract(id, '([^:]*)$', 1) AS last FROM ln GROUP BY id), "
       "q AS (SELECT DISTINCT trim(query) AS query FROM (SELECT name AS query FROM node_facts UNION SELECT upper(name) FROM node_facts UNION SELECT id FROM node_facts UNION SELECT id FROM ln UNION SELECT regexp_replace(id, '^[^:]*:', '') FROM ln UNION SELECT regexp_extract(id, '([^.]*)$', 1) FROM ln) WHERE trim(query) <> ''), "
       "h AS (SELECT query, 1 AS stage, id FROM q JOIN n ON n.id = query UNION SELECT query, 2, id FROM q JOIN n ON ident = query UNION SELECT query, 3, id FROM q JOIN n ON name = query UNION SELECT query, 4, id FROM q JOIN n ON lower(name) = lower(query) "
       "UNION SELECT query, 5, id FROM q JOIN n ON ident = query OR ends_with(ident, '.' || query) UNION SELECT query, 6, id FROM q JOIN n ON last = query OR ends_with(id, ':' || query) UNION SELECT query, 7, id FROM q JOIN n ON lower(last) = lower(query)), "
       "s AS (SELECT query, stage, count(DISTINCT id) AS matches, min(id) AS id, row_number() OVER (PARTITION BY query ORDER BY stage) AS k FROM h GROUP BY query, stage) SELECT query, stage, matches, id FROM s WHERE k = 1")
def resolve_cascade(spark, sf):
    """What the names and ids of all facts mean among the nodes of the last scans."""
    nodes = model.merge_nodes(latest_graph(spark, sf).nodes)
    facts, latest = table(spark, sf, "node_facts"), latest_graph(spark, sf).nodes
    asked = [facts.select("name"), facts.select(F.upper("name")), facts.select("id"), latest.select("id"), latest.select(F.regexp_replace("id", "^[^:]*:", "")), latest.select(F.regexp_extract("id", r"([^.]*)$", 1))]
    texts = asked[0].toDF("query")
    for a in asked[1:]:
        texts = texts.union(a)
    return resolve.match_stages(nodes, texts)


# scope and assets

def _scope_sql() -> str:
    out = [TYPED_SQL, """
fwd AS (SELECT DISTINCT source AS a, target AS b FROM tedges), around AS (SELECT a, b FROM fwd UNION SELECT b, a FROM fwd),
anchors AS (SELECT id FROM typed WHERE type = 'sql_table'), bridges AS (SELECT id FROM typed WHERE type IN ('api_route', 'temp_view')),
handlers AS (SELECT id FROM typed WHERE type LIKE 'python%' AND id IN (SELECT b FROM around WHERE a IN (SELECT id FROM bridges))),
k0 AS (SELECT id FROM anchors UNION SELECT b FROM around WHERE a IN (SELECT id FROM anchors))"""]
    for i in range(3):
        out.append(f"""
f{i}(id) AS (SELECT id FROM k{i} UNION SELECT b FROM f{i} JOIN fwd ON a = id), r{i}(id) AS (SELECT id FROM k{i} UNION SELECT a FROM r{i} JOIN fwd ON b = id),
c{i} AS (SELECT id FROM k{i} UNION (SELECT id FROM f{i} INTERSECT SELECT id FROM r{i})),
h{i} AS (SELECT id FROM c{i} UNION SELECT id FROM handlers WHERE id IN (SELECT b FROM around WHERE a IN (SELECT id FROM c{i})) OR id IN (SELECT id FROM f{i}) OR id IN (SELECT id FROM r{i})),
g{i}(id) AS (SELECT id FROM h{i} UNION SELECT b FROM g{i} JOIN fwd ON a = id),
k{i + 1} AS (SELECT id FROM h{i} UNION SELECT id FROM bridges WHERE id IN (SELECT b FROM around WHERE a IN (SELECT id FROM h{i})) OR id IN (SELECT id FROM g{i}))""")
    return "WITH RECURSIVE " + ",".join(out) + " SELECT id, type FROM typed WHERE id IN (SELECT id FROM k3)"


@query(_scope_sql())
def scope_projection(spark, sf):
    """The nodes in the scope of lineage."""
    return scope.lineage_scope(typed_graph(spark, sf)).nodes.select("id", "type")


@query(f"WITH {ASSET_SQL} SELECT source, target, array_to_string(via, '|') AS via, place::INT AS place FROM paths WHERE place <= 3")
def asset_paths(spark, sf):
    """The first three paths between assets."""
    return assets.asset_paths(asset_test_graph(spark, sf)).select("source", "target", F.array_join("via", "|").alias("via"), "place")


@query(f"WITH {ASSET_SQL}, hops AS (SELECT source, target, unnest(list_zip(list_prepend(source, via), list_append(via, target))) AS h FROM paths WHERE place = 1) "
       "SELECT hops.source, hops.target, min(c)::INT AS confidence, 'asset projection' AS evidence, '3' AS hops FROM hops JOIN ae ON ae.source = h[1] AND ae.target = h[2] GROUP BY hops.source, hops.target")
def asset_edges(spark, sf):
    """Contracted edges between assets with the confidence of their weakest hop."""
    edges = assets.asset_graph(asset_test_graph(spark, sf)).edges
    return edges.select("source", "target", F.col("confidence").cast("int").alias("confidence"), F.array_join("evidence", "|").alias("evidence"), F.col("metadata")["hops"].alias("hops"))


@query(f"WITH {ASSET_SQL}, f AS (SELECT source, target, list_append(list_prepend(source, via), target) AS p FROM paths WHERE place = 1) "
       "SELECT source, target, k::INT AS position, p[k + 1] AS id, p[k + 1] AS name FROM f, range(0, 5) r(k) WHERE k < len(p)")
def hidden_hops(spark, sf):
    """The nodes behind each contracted edge."""
    g = asset_test_graph(spark, sf)
    return views.hidden_hops(assets.asset_graph(g).edges, g.nodes)


# topology

def _links(spark, sf) -> Graph:
    ends = table(spark, sf, "asset_edges").select(ids.strip(F.col("source")).alias("source"), ids.strip(F.col("target")).alias("target"), "type")
    names = ends.select(F.explode(F.array("source", "target")).alias("id")).filter("id is not null").distinct()
    return Graph(names.select("id", ids.strip(F.regexp_extract("id", r"([^.]*)$", 1)).alias("name"), F.regexp_extract("id", "^([^:]*)", 1).alias("type")), ends.filter("source is not null and target is not null"))


_LINKS = r"""lk AS (SELECT DISTINCT regexp_replace(source, '^\s+|\s+$', '', 'g') AS source, regexp_replace(target, '^\s+|\s+$', '', 'g') AS target FROM asset_edges),
names AS (SELECT source AS id FROM lk WHERE source IS NOT NULL UNION SELECT target FROM lk WHERE target IS NOT NULL), pairs AS (SELECT * FROM lk WHERE source IS NOT NULL AND target IS NOT NULL)"""


@query(f"WITH RECURSIVE {_LINKS}, p(path, cur) AS (SELECT [id], id FROM names WHERE id NOT IN (SELECT target FROM pairs) UNION ALL SELECT list_append(path, target), target FROM p JOIN pairs ON source = cur WHERE NOT list_contains(path, target)) "
       "SELECT array_to_string(path, ' > ') AS path FROM p WHERE NOT EXISTS (SELECT 1 FROM pairs WHERE source = cur AND NOT list_contains(path, target))")
def root_sink_paths(spark, sf):
    """All simple paths from roots to sinks of the asset links."""
    g = _links(spark, sf)
    return traverse.root_paths(g.nodes, g.edges, limit=None).select(F.array_join("path", " > ").alias("path"))


@query(f"WITH RECURSIVE {_LINKS}, p(path, cur) AS (SELECT [id], id FROM names WHERE id NOT IN (SELECT target FROM pairs) UNION ALL SELECT list_append(path, target), target FROM p JOIN pairs ON source = cur WHERE NOT list_contains(path, target)), "
       "done AS (SELECT path FROM p WHERE NOT EXISTS (SELECT 1 FROM pairs WHERE source = cur AND NOT list_contains(path, target)) ORDER BY path[1] IN (SELECT source FROM pairs) DESC, path LIMIT 80) "
       "SELECT row_number() OVER (ORDER BY path[1] IN (SELECT source FROM pairs) DESC, path)::INT AS position, array_to_string(list_transform(path, lambda x: regexp_extract(x, '([^.]*)$', 1) || CASE WHEN starts_with(x, 'python_function:') AND NOT ends_with(x, '()') THEN '()' ELSE '' END), chr(10) || '   ↓' || chr(10)) AS chain FROM done")
def chains(spark, sf):
    """The chains that the command line prints, at most 80."""
    return render.chains(_links(spark, sf))


@query(f"WITH RECURSIVE {_LINKS}, b AS (SELECT source AS a, target AS b FROM pairs UNION SELECT target, source FROM pairs), r(id, x) AS (SELECT id, id FROM names UNION SELECT r.id, b.b FROM r JOIN b ON b.a = r.x) SELECT id, min(x) AS component FROM r GROUP BY id")
def components(spark, sf):
    """Weakly connected components of the asset links."""
    g = _links(spark, sf)
    return traverse.components(g.nodes, g.edges)


@query(f"WITH RECURSIVE {_LINKS}, b AS (SELECT source AS a, target AS b FROM pairs UNION SELECT target, source FROM pairs), r(id) AS (SELECT min(id) FROM names UNION SELECT b FROM r JOIN b ON a = id) "
       "SELECT id, regexp_extract(id, '([^.]*)$', 1) AS name, regexp_extract(id, '^([^:]*)', 1) AS type FROM r WHERE id IS NOT NULL")
def focus(spark, sf):
    """The component of one asset, the first by id."""
    g = _links(spark, sf)
    first = g.nodes.agg(F.min("id")).first()[0]
    return views.focus(g, first).nodes if first else g.nodes.limit(0)


_LAYERS = f"{FK_SQL}, d(id, layer) AS (SELECT id, 0 FROM fk_nodes UNION SELECT target, layer + 1 FROM d JOIN fk ON source = id WHERE layer < 10), layered AS (SELECT id, max(layer)::INT AS layer FROM d GROUP BY id)"


@query(f"WITH RECURSIVE {_LAYERS} SELECT * FROM layered")
def layers(spark, sf):
    """The longest distance of every row from a root."""
    g = fk_graph(spark, sf)
    return traverse.layers(g.nodes, g.edges)


# every child has one parent here, so a cycle is entered nowhere and begins at its smallest id
@query(rf"""WITH RECURSIVE {_LINKS}, up AS (SELECT target AS v, min(source) AS p FROM pairs GROUP BY target), placed(v, layer) AS (SELECT id, 0 FROM names WHERE id NOT IN (SELECT v FROM up) UNION ALL SELECT u.v, layer + 1 FROM placed JOIN up u ON u.p = placed.v),
lost AS (SELECT * FROM up WHERE v NOT IN (SELECT v FROM placed)), reach(v, a) AS (SELECT v, p FROM lost UNION SELECT r.v, l.p FROM reach r JOIN lost l ON l.v = r.a),
heads AS (SELECT min(a) AS v FROM reach WHERE v IN (SELECT v FROM reach WHERE v = a) GROUP BY v), behind(v, layer) AS (SELECT DISTINCT v, 0 FROM heads UNION ALL SELECT l.v, layer + 1 FROM behind b JOIN lost l ON l.p = b.v WHERE l.v NOT IN (SELECT v FROM heads))
SELECT v AS id, layer::INT AS layer FROM placed UNION ALL SELECT v, layer FROM behind""")
def layers_cyclic(spark, sf):
    """Layers of the asset links with the smallest parent of each child, cycles and what hangs on them included."""
    g = _links(spark, sf)
    return traverse.layers(g.nodes, g.edges.groupBy("target").agg(F.min("source").alias("source")))


# drawn by hand: natural ids that look numbered, ids that begin with a digit, ids without any letter
_COLLIDING = ("1x", "a-b", "a.b", "a_b", "a_b_2", "a_b_3", "a_b_4", "b", "?", "!", "n")


@query("SELECT * FROM (VALUES ('1x', 'n_1x'), ('a-b', 'a_b'), ('a.b', 'a_b_2'), ('a_b', 'a_b_3'), ('a_b_2', 'a_b_2_2'), ('a_b_3', 'a_b_3_2'), ('a_b_4', 'a_b_4'), ('b', 'b'), ('!', 'n'), ('?', 'n_2'), ('n', 'n_3')) t(id, shown)")
def mermaid_collisions(spark, sf):
    """Short ids that would collide with numbered ones."""
    return views.suffixed_ids(_start(spark, *_COLLIDING), ids.mermaid_id(F.col("id")))


def _order_sql() -> str:
    out = [_LAYERS, "o0 AS (SELECT id, layer, row_number() OVER (PARTITION BY layer ORDER BY id) - 1 AS position FROM layered)"]
    for i, (layer, side) in enumerate([(x, 0) for x in range(4)] + [(x, 1) for x in (3, 2, 1, 0)] + [(x, 0) for x in range(4)]):
        own, other = (("target", "source"), ("source", "target"))[side]
        out.append(f"a{i} AS (SELECT {own} AS id, avg(position) AS m FROM fk JOIN o{i} ON o{i}.id = {other} GROUP BY {own}), b{i} AS (SELECT {other} AS id, avg(position) AS m FROM fk JOIN o{i} ON o{i}.id = {own} GROUP BY {other})")
        out.append(f"o{i + 1} AS (SELECT id, layer, CASE WHEN layer = {layer} THEN row_number() OVER (PARTITION BY layer ORDER BY coalesce(a{i}.m, b{i}.m, position::DOUBLE), id) - 1 ELSE position END AS position FROM o{i} LEFT JOIN a{i} USING (id) LEFT JOIN b{i} USING (id))")
    return "WITH RECURSIVE " + ", ".join(out) + " SELECT id, 'all' AS component, layer, position::INT AS position FROM o12"


@query(_order_sql())
def column_order(spark, sf):
    """Places within layers after three barycentre sweeps."""
    g = fk_graph(spark, sf, raw=True)  # repeats are dropped with the links
    return traverse.layered_order(g.nodes, g.edges)


@query()
def layout(spark, sf):
    """Boxes of a drawing of the rows and their references."""
    return views.layout(fk_graph(spark, sf, raw=True))  # repeats are dropped with the links


@query(f"WITH {JOURNEY_SQL} SELECT source, array_to_string(list_sort(list(target)), ',') AS targets FROM journey GROUP BY source")
def adjacency_lists(spark, sf):
    """Sorted neighbours of every step."""
    return model.adjacency(journey_graph(spark, sf).edges).select("source", F.array_join("targets", ",").alias("targets"))


# filters and views

@query(f"WITH {FK_SQL} SELECT type, count(*) AS nodes FROM fk_nodes GROUP BY type")
def type_counts(spark, sf):
    """Nodes of each type."""
    return model.type_counts(fk_graph(spark, sf).nodes)


@query(f"WITH {LATEST_SQL} SELECT 'node' AS kind, type FROM ln WHERE type IS NOT NULL UNION SELECT 'edge', type FROM le WHERE type IS NOT NULL")
def type_inventory(spark, sf):
    """The types that occur in the last scans."""
    g = latest_graph(spark, sf)
    kinds = [df.select(F.lit(k).alias("kind"), "type").filter("type is not null") for k, df in (("node", g.nodes), ("edge", g.edges))]
    return kinds[0].unionByName(kinds[1]).distinct()


@query(f"WITH {LATEST_SQL} SELECT type, count(DISTINCT id) AS nodes, count(DISTINCT id) FILTER (metadata['imported'] = 'true') AS imported, count(DISTINCT file_path) AS files FROM ln WHERE type IS NOT NULL GROUP BY type")
def scan_summary(spark, sf):
    """Counts of the last scans by type and flag."""
    n = latest_graph(spark, sf).nodes.filter("type is not null")
    return n.groupBy("type").agg(
        F.count_distinct("id").alias("nodes"), F.count_distinct(F.when(F.col("metadata")["imported"] == "true", F.col("id"))).alias("imported"), F.count_distinct("file_path").alias("files")
    )


_CLASSES = """SELECT DISTINCT type, coalesce(type IN ({anchor}), false) AS anchor, coalesce(regexp_matches(lower(trim(type)), '(_function|_module|_class|_method|_file)$'), false) AS code,
coalesce(type IN ({asset}), false) AS asset FROM graph_nodes""".format(anchor=", ".join(f"'{t}'" for t in model.ANCHOR_TYPES), asset=", ".join(f"'{t}'" for t in model.ASSET_TYPES))


@query(f"SELECT *, NOT anchor AND NOT code AS bridge FROM ({_CLASSES})")
def type_classes(spark, sf):
    """The classes of every delivered type."""
    t = F.col("type")
    return table(spark, sf, "graph_nodes").select("type").distinct().select("type", model.is_anchor(t).alias("anchor"), model.is_code(t).alias("code"), model.is_asset(t).alias("asset"), model.is_bridge(t).alias("bridge"))


@query(f"WITH {TYPED_SQL} SELECT id, type FROM typed WHERE type = 'api_route'")
def filter_only(spark, sf):
    """Nodes of one type."""
    return views.by_type(typed_graph(spark, sf), ["api_route"]).nodes.select("id", "type")


@query(f"WITH {TYPED_SQL}, m AS (SELECT id FROM typed WHERE type = 'api_route') SELECT id, type FROM typed WHERE id IN (SELECT id FROM m UNION SELECT source FROM tedges WHERE target IN (SELECT id FROM m) UNION SELECT target FROM tedges WHERE source IN (SELECT id FROM m))")
def filter_context(spark, sf):
    """Nodes of one type and their neighbours."""
    return views.by_type(typed_graph(spark, sf), ["api_route"], "context").nodes.select("id", "type")


@query(f"WITH {FK_SQL}, m AS (SELECT id FROM fk_nodes WHERE lower(name || ' ' || id || ' ' || type) LIKE '%nation_1%') SELECT id, name FROM fk_nodes WHERE id IN (SELECT id FROM m UNION SELECT source FROM fk WHERE target IN (SELECT id FROM m) UNION SELECT target FROM fk WHERE source IN (SELECT id FROM m))")
def search_context(spark, sf):
    """Nodes with a text and their neighbours."""
    return views.search(fk_graph(spark, sf), "NATION_1").nodes.select("id", "name")


@query(f"WITH {LATEST_SQL}, i AS (SELECT DISTINCT id FROM (SELECT id FROM ln)), {_LINKS}, l AS (SELECT id, CASE WHEN starts_with(p, 'bronze.') OR contains(p, '.bronze.') THEN 'bronze' WHEN starts_with(p, 'silver.') OR contains(p, '.silver.') THEN 'silver' "
       "WHEN starts_with(p, 'gold.') OR contains(p, '.gold.') THEN 'gold' END AS layer FROM (SELECT id, regexp_replace(id, '^[^:]*:', '') AS p FROM names)) SELECT id, layer, CASE layer WHEN 'bronze' THEN 0 WHEN 'silver' THEN 1 ELSE 2 END AS rank FROM l WHERE layer IS NOT NULL")
def namespace_tag(spark, sf):
    """The layer that an asset's id names."""
    return views.namespaces(_links(spark, sf).nodes)


@query(f"WITH {FK_SQL} SELECT 'upstream' AS direction, source AS id FROM fk WHERE target = 'nation:3' UNION ALL SELECT 'downstream', target FROM fk WHERE source = 'nation:3'")
def connections(spark, sf):
    """The edges of one node, seen from it."""
    return views.connections(fk_graph(spark, sf), "nation:3").select("direction", "id")


@query(f"WITH {FK_SQL} SELECT 'nation:3' AS id UNION SELECT source FROM fk WHERE target = 'nation:3' UNION SELECT target FROM fk WHERE source = 'nation:3'")
def highlight(spark, sf):
    """A node with what is directly above and below it."""
    return views.highlight(fk_graph(spark, sf), "nation:3", "both")


# scalar functions

_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


@query(r"SELECT fact_id, nullif(array_to_string(list_filter(list_transform(string_split(regexp_replace(trim(id), '^[^:]*:', ''), '.'), lambda p: lower(regexp_replace(p, '^[\s`''"
       r""""\[\]]+|[\s`''"\[\]]+$', '', 'g'))), lambda p: p <> ''), '.'), '') AS name FROM node_facts WHERE id LIKE '%sql_table%'""".replace('""\\[', '"\\['))
def normalize_table_names(spark, sf):
    """Table names without quotes, brackets and blanks, in lower case."""
    facts = table(spark, sf, "node_facts").filter("id like '%sql_table%'")
    return facts.select("fact_id", ids.relation_key(F.regexp_replace(F.trim("id"), "^[^:]*:", "")).alias("name"))


_ROUTES = r"r AS (SELECT fact_id, regexp_replace(string_split(id, ':')[2], '^\s+|\s+$', '', 'g') AS m, regexp_replace(string_split(id, ':')[3], '^\s+|\s+$', '', 'g') AS p FROM node_facts WHERE id LIKE '%api_route%')"


@query(f"WITH {_ROUTES} SELECT fact_id, 'api_route:' || upper(m) || ':' || CASE WHEN starts_with(p, '/') THEN p ELSE '/' || p END AS id FROM r")
def route_ids(spark, sf):
    """Ids of routes from methods and paths as parsers wrote them."""
    facts = table(spark, sf, "node_facts").filter("id like '%api_route%'")
    return facts.select("fact_id", ids.api_route_id(F.get(F.split("id", ":"), 1), F.get(F.split("id", ":"), 2)).alias("id"))


@query(f"WITH {_ROUTES} SELECT fact_id, '/' || upper(m) || CASE WHEN starts_with(p, '/') THEN p ELSE '/' || p END AS path FROM r")
def join_paths(spark, sf):
    """Routes below a prefix."""
    facts = table(spark, sf, "node_facts").filter("id like '%api_route%'")
    method = F.upper(ids.strip(F.get(F.split("id", ":"), 1)))
    return facts.select("fact_id", ids.join_paths(F.concat(method, F.lit("/")), F.get(F.split("id", ":"), 2)).alias("path"))


@query(r"WITH e AS (SELECT fact_id, lower(regexp_replace(regexp_replace(regexp_replace(id, '^\s+|\s+$', '', 'g'), '^external_system:', ''), '^\s+|\s+$', '', 'g')) AS a FROM node_facts WHERE id LIKE '%external_system%') "
       r"SELECT fact_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(a, '^[a-z][a-z0-9+.-]*://', ''), '[/?#].*$', ''), '^.*@', ''), ':.*$', '') AS host, "
       r"CASE WHEN regexp_matches(a, '^https?://[^/]') THEN regexp_replace(regexp_extract(a, '^https?://([^/?#]*)', 1), '^.*@|:[0-9]*$', '', 'g') END AS http_host FROM e")
def external_hosts(spark, sf):
    """Hosts of addresses as parsers wrote them."""
    facts = table(spark, sf, "node_facts").filter("id like '%external_system%'")
    address = ids.strip(F.regexp_replace(ids.strip(F.col("id")), "^external_system:", ""))
    return facts.select("fact_id", ids.host_of(address).alias("host"), ids.http_host(address).alias("http_host"))


@query(f"WITH {_LINKS}, c AS (SELECT id, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(id, '[0-9]+', '', 'g'), '[^A-Za-z0-9_]', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'n') AS raw FROM names), "
       "k AS (SELECT *, CASE WHEN regexp_matches(raw, '^[0-9]') THEN 'n_' || raw ELSE raw END AS clean, row_number() OVER (PARTITION BY raw ORDER BY id) AS n FROM c) SELECT id, CASE WHEN n = 1 THEN clean ELSE clean || '_' || n END AS shown FROM k")
def mermaid_ids(spark, sf):
    """Short unique ids with numbered suffixes."""
    return views.suffixed_ids(_links(spark, sf).nodes, ids.mermaid_id(F.regexp_replace("id", "[0-9]+", "")))


@query("SELECT file_id FROM source_files WHERE (regexp_matches(file_path, '^src/.*$') OR regexp_matches(file_path, '^(?:.*/)?[^/]*[.]sql$')) AND NOT regexp_matches(file_path, '^src/jobs/[^/]*$')")
def glob_filter(spark, sf):
    """Files that include and exclude patterns leave."""
    return table(spark, sf, "source_files").filter(ids.included(F.col("file_path"), ["src/**", "**/*.sql"], ["src/jobs/*"])).select("file_id")


@query(r"SELECT file_id, contains(content, '{{') OR contains(content, '{%') OR contains(content, '{#') AS jinja, len(regexp_extract_all(content, '\{\{')) <> len(regexp_extract_all(content, '\}\}')) OR "
       r"len(regexp_extract_all(content, '\{%')) <> len(regexp_extract_all(content, '%\}')) AS unbalanced FROM source_files")
def jinja_flags(spark, sf):
    """Files with Jinja, and with unbalanced marks."""
    text = F.col("content")
    return table(spark, sf, "source_files").select("file_id", ids.looks_like_jinja(text).alias("jinja"), ids.jinja_is_unbalanced(text).alias("unbalanced"))


@query(r"SELECT file_id, coalesce(lower(regexp_extract(content, '^[\s(]*([^\s(;]+)', 1)) IN (" + ", ".join(f"'{w}'" for w in ids.SQL_STARTS) + "), false) AS sql FROM source_files")
def sql_start(spark, sf):
    """Whether a file begins like a statement."""
    return table(spark, sf, "source_files").select("file_id", ids.looks_like_sql(F.col("content")).alias("sql"))


@query(r"SELECT file_id, 'python_module:' || replace(regexp_replace(regexp_replace(regexp_replace(file_path, '\.py$', '', 'i'), '^src/', ''), '(^|/)__init__$', ''), '/', '.') AS id FROM source_files WHERE lower(file_path) LIKE '%.py'")
def module_names(spark, sf):
    """Ids of modules from paths."""
    return table(spark, sf, "source_files").filter(F.lower("file_path").like("%.py")).select("file_id", ids.python_module_id(ids.module_of_path(F.col("file_path"))).alias("id"))


@query("SELECT file_id, nullif(list_position(list_transform(string_split(content, chr(10)), lambda x: contains(x, 'import ') OR contains(x, 'SELECT')), true), 0)::BIGINT AS line FROM source_files")
def first_line(spark, sf):
    """The first line with an import or a select."""
    return table(spark, sf, "source_files").select("file_id", views.first_line_matching(F.col("content"), ["import ", "SELECT"]).alias("line"))


@query(f"WITH {LATEST_SQL}, last_of AS (SELECT repo, arg_max(scan_id, (scan_timestamp::TIMESTAMPTZ, scan_id)) AS scan_id FROM scans GROUP BY repo), "
       "cited AS (SELECT DISTINCT repo || '/' || file_path AS file_path, line_number FROM ln JOIN last_of USING (scan_id) WHERE file_path IS NOT NULL), "
       r"f AS (SELECT repo || '/' || file_path AS file_path, string_split(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS l FROM source_files) "
       "SELECT file_path, line_number, greatest(1, line_number - 5)::INT AS first_line, array_to_string(l[greatest(1, line_number - 5):line_number + 5], chr(10)) AS excerpt FROM cited JOIN f USING (file_path) WHERE line_number BETWEEN 1 AND len(l)")
def excerpt(spark, sf):
    """The lines around every place that a node of the last scans cites."""
    from weft.operators.changes import consecutive, instant

    scans = consecutive(table(spark, sf, "scans"), "scan_id", "repo", instant(F.col("scan_timestamp")), "received_at").filter("later is null")
    key = F.concat("repo", F.lit("/"), "file_path").alias("file_path")
    cited = table(spark, sf, "graph_nodes").filter("id is not null and file_path is not null").join(scans.select(F.col("snapshot").alias("scan_id"), F.col("series").alias("repo")), "scan_id").select(key, "line_number")
    return views.excerpts(cited, table(spark, sf, "source_files").select(key, "content"))


@query("SELECT edge_id, array_to_string(list_filter([CASE WHEN type <> '' THEN 'operation=\"' || type || '\"' END, CASE WHEN confidence > 0 THEN 'line_number=' || confidence END, CASE WHEN repo <> '' THEN 'file_path=\"' || repo || '\"' END], lambda x: x IS NOT NULL), ',') AS metadata FROM asset_edges".replace(
    "[CASE WHEN type", "[CASE WHEN repo <> '' THEN 'file_path=\"' || repo || '\"' END, CASE WHEN confidence > 0 THEN 'line_number=' || confidence END, CASE WHEN type").replace(", CASE WHEN confidence > 0 THEN 'line_number=' || confidence END, CASE WHEN repo <> '' THEN 'file_path=\"' || repo || '\"' END], lambda", "], lambda"))
def evidence_metadata(spark, sf):
    """Maps of evidence without what says nothing."""
    made = ids.evidence_metadata(file_path=F.col("repo"), line_number=F.col("confidence").cast("int"), operation=F.col("type"))
    return table(spark, sf, "asset_edges").select("edge_id", made.alias("metadata")).select("edge_id", _map_text().alias("metadata"))


@query(f"WITH {LATEST_SQL} SELECT id, min(CASE WHEN type = 'python_function' AND NOT ends_with(name, '()') THEN name || '()' ELSE name END) AS label FROM ln GROUP BY id")
def display_names(spark, sf):
    """Names as they are shown."""
    return latest_graph(spark, sf).nodes.groupBy("id").agg(F.min(ids.display_name(F.col("name"), F.col("type"))).alias("label"))


# extraction and rendering, for which SQL has no counterpart

def _facts(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "source_files").select("repo", F.col("file_path").alias("path"), "content")
    return extract_facts(files, ["repo"])


@query()
def extract_files(spark, sf):
    """The facts of every source file."""
    return _facts(spark, sf).select("repo", "file", "parser", "seq", "kind", "id", "type", "source", "target", "confidence", "evidence", "message")


@query()
def scan_files(spark, sf):
    """The graph of all source files, each repository under its own ids."""
    facts = _facts(spark, sf)
    own = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.regexp_extract(c, "^([^:]*:)", 1), F.col("repo"), F.lit("/"), F.regexp_replace(c, "^[^:]*:", ""))).alias(c)
    facts = facts.select(own("id"), own("source"), own("target"), *(c for c in facts.columns if c not in ("id", "source", "target")))
    graph, _ = model.build_graph(fact_nodes(facts), fact_edges(facts))
    return graph.edges.select("source", "target", "type", "confidence", F.array_join("evidence", "|").alias("evidence"))


@query()
def suggest(spark, sf):
    """Nodes whose ids or names look like a misspelt one."""
    return resolve.suggest(latest_graph(spark, sf).nodes, "python_function:platform_core.telemetri.emit")


@query(f"WITH {LATEST_SQL}, {_merged('j', 'ln', 'id')}, obj AS (SELECT id, string_agg(to_json(key)::VARCHAR || ':' || v, ',' ORDER BY key) AS m FROM best_j GROUP BY id), "
       "n AS (SELECT id, min(nullif(name, '')) AS name, min(nullif(type, '')) AS type, min(nullif(file_path, '')) AS file_path, min(line_number) AS line_number FROM ln GROUP BY id) "
       "SELECT '{\"id\":' || to_json(id)::VARCHAR || ',\"name\":' || coalesce(to_json(name)::VARCHAR, 'null') || ',\"type\":' || coalesce(to_json(type)::VARCHAR, 'null') || ',\"file_path\":' || coalesce(to_json(file_path)::VARCHAR, 'null') "
       "|| ',\"line_number\":' || coalesce(line_number::VARCHAR, 'null') || ',\"metadata\":{' || coalesce(m, '') || '}}' AS line FROM n LEFT JOIN obj USING (id)")
def canonical_json(spark, sf):
    """Canonical JSON objects of the merged nodes of the last scans."""
    g = latest_graph(spark, sf)
    return store.json_rows(Graph(model.merge_nodes(g.nodes), model.merge_edges(g.edges)))[0]


@query(f"WITH {_LINKS}, c AS (SELECT id, coalesce(nullif(regexp_replace(regexp_replace(id, '[^A-Za-z0-9_]', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'n') AS raw FROM names), "
       "k AS (SELECT *, CASE WHEN regexp_matches(raw, '^[0-9]') THEN 'n_' || raw ELSE raw END AS clean, row_number() OVER (PARTITION BY raw ORDER BY id) AS n FROM c) SELECT id, replace(regexp_extract(id, '([^.]*)$', 1), chr(34), chr(39)) || CASE WHEN starts_with(id, 'python_function:') AND NOT ends_with(id, '()') THEN '()' ELSE '' END AS label, "
       "CASE WHEN n = 1 THEN clean ELSE clean || '_' || n END AS shown FROM k")
def mermaid_nodes(spark, sf):
    """Ids and labels of a drawing of the asset links."""
    return render.mermaid_nodes(_links(spark, sf).nodes)
