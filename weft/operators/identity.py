"""Dataset identity: references to physical tables become the dataset that declares them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.ids import relation_key
from weft.operators.model import Graph, merge_edges, merge_nodes


def _text(key: str) -> Column:
    """A metadata value that is a JSON text, without its quotes; null for blanks and other values."""
    value = F.col("metadata")[key]
    return F.when(value.rlike(r'^".*\S.*"$'), F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v"))


def _unique(pairs: DataFrame) -> DataFrame:
    """(key, id): keys that only one id claims."""
    return pairs.filter("key is not null").groupBy("key").agg(F.min("id").alias("id"), F.max("id").alias("last")).filter("id = last").select("key", "id")


def declarations(nodes: DataFrame) -> dict[str, DataFrame]:
    """Lookups (key, id) by kind of declaration, each keyed by the normalised relation name.

    pipeline: declared datasets, the smallest id wins; relation: qualified relations of dbt models; source: dotted names
    of dbt sources; model: bare names of dbt models. In the last three a key that several ids claim is left out.
    """
    own = relation_key(F.regexp_replace("id", r"^[^:]*:?", "")).alias("key")
    declared = F.coalesce(F.col("metadata")["dataset_declaration"], F.lit("false")).isin("false", '""', "null", "0", "") == F.lit(False)
    pipeline = nodes.filter((F.col("type") == "pipeline_dataset") & declared).select(own, "id").filter("key is not null")
    models, sources = nodes.filter("type = 'dbt_model'"), nodes.filter("type = 'dbt_source'")
    table = F.coalesce(_text("alias"), F.col("name"))
    qualified = F.array_distinct(
        F.array(
            relation_key(_text("relation_name")), relation_key(F.concat(_text("database"), F.lit("."), _text("schema"), F.lit("."), table)),
            relation_key(F.concat(_text("schema"), F.lit("."), table)),
        )
    )
    return {
        "pipeline": pipeline.groupBy("key").agg(F.min("id").alias("id")),
        "relation": _unique(models.select(F.explode(qualified).alias("key"), "id")),
        "source": _unique(sources.select(own, "id").filter(F.col("key").contains("."))),
        "model": _unique(models.select(own, "id").filter(~F.col("key").contains("."))),
    }


def rewrites(nodes: DataFrame) -> DataFrame:
    """(id, canonical): the tables that stand for a declared dataset, and which.

    A pipeline dataset comes before a dbt relation, that before a dbt source, and a bare model name only serves
    references without a schema. All other references stay.
    """
    found = nodes.filter("type = 'sql_table'").select("id", relation_key(F.regexp_replace("id", r"^[^:]*:?", "")).alias("key")).filter("key is not null")
    for name, lookup in declarations(nodes).items():
        found = found.join(lookup.withColumnRenamed("id", name), "key", "left")
    bare = F.when(~F.col("key").contains("."), F.col("model"))
    return found.select("id", F.coalesce("pipeline", "relation", "source", bare).alias("canonical")).filter("canonical is not null and canonical <> id")


def resolve_identity(graph: Graph) -> Graph:
    """The graph with references merged into their declarations; edges that become loops are dropped.

    What is known of a reference stays in the metadata, except its physical identity; ``referenced_as`` has its name.
    """
    moves = rewrites(graph.nodes)
    heads = graph.nodes.select(F.col("id").alias("canonical"), F.col("name").alias("c_name"), F.col("type").alias("c_type"))
    kept = graph.nodes.join(moves, "id", "left_anti").select("id", "name", "type", "file_path", "line_number", "metadata")
    moved = graph.nodes.join(moves, "id").join(heads, "canonical")
    remaining = F.map_filter("metadata", lambda k, _: ~k.isin("relation_ref", "table", "referenced_as"))
    as_name = F.regexp_extract(F.to_json(F.struct(F.col("name").alias("v"))), r'^\{"v":(.*)\}$', 1)
    stubs = moved.select(
        F.col("canonical").alias("id"), F.col("c_name").alias("name"), F.col("c_type").alias("type"), F.lit(None).cast("string").alias("file_path"),
        F.lit(None).cast("int").alias("line_number"), F.map_concat(F.coalesce(remaining, F.create_map().cast("map<string,string>")), F.create_map(F.lit("referenced_as"), as_name)).alias("metadata"),
    )
    edges = graph.edges
    for end in ("source", "target"):
        edges = edges.join(moves.select(F.col("id").alias(end), F.col("canonical").alias("_to")), end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    return Graph(merge_nodes(kept.unionByName(stubs)), merge_edges(edges.filter("source <> target").select(*graph.edges.columns)))
