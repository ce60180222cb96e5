"""Incremental rescans: facts of files as they arrive, and graphs that follow them.

New deliveries of files are a stream. A file whose content was seen is not parsed again; the facts of the rest are
appended, and a view of the latest facts per file gives the graph at any time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weft.operators.model import Graph, build_graph
from weft.sources.repository import extract_facts, fact_edges, fact_nodes

#: Deliveries of the same content within this time of each other are parsed once.
LATENESS = "1 day"


def changed_files(deliveries: DataFrame, keys: list[str], at: str, lateness: str = LATENESS) -> DataFrame:
    """``keys``, path, content and time of deliveries whose content is new for their path.

    ``deliveries`` is a stream or a table with ``keys``, path, content and the time column ``at``. Copies are dropped with
    bounded state: digests older than ``lateness`` are forgotten, and a copy after that is parsed again, with the same
    facts.
    """
    seen = deliveries.select(*keys, "path", "content", F.col(at).cast("timestamp").alias("at"), F.sha2("content", 256).alias("digest"))
    return seen.withWatermark("at", lateness).dropDuplicatesWithinWatermark([*keys, "path", "digest"]) if seen.isStreaming else seen.dropDuplicates([*keys, "path", "digest"])


def stream_facts(deliveries: DataFrame, keys: list[str], at: str, out: str, checkpoint: str, lateness: str = LATENESS) -> StreamingQuery:
    """Starts appending facts of changed files to the Parquet folder ``out``; ends when all that is there is done."""
    fresh = changed_files(deliveries, keys, at, lateness)

    def write(batch: DataFrame, number: int) -> None:
        times = batch.groupBy(*keys, "path").agg(F.max("at").alias("delivered_at"))
        latest = Window.partitionBy(*keys, "path").orderBy(F.col("at").desc(), "digest")
        files = batch.withColumn("n", F.row_number().over(latest)).filter("n = 1").select(*keys, "path", "content")
        facts = extract_facts(files, keys).join(times.withColumnRenamed("path", "file"), [*keys, "file"])
        # a folder a batch makes a repeated batch overwrite itself
        facts.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_graph(facts: DataFrame, keys: list[str]) -> tuple[Graph, DataFrame]:
    """The graph of the facts of each file's last delivery, and its warnings."""
    last = facts.groupBy(*keys, "file").agg(F.max("delivered_at").alias("delivered_at"))
    current = facts.join(last, [*keys, "file", "delivered_at"], "left_semi")
    return build_graph(fact_nodes(current), fact_edges(current))
