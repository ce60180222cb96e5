"""What changed between consecutive full snapshots of a table.

Snapshots are sorted by key and cut into content-defined chunks: a chunk starts at every key whose hash has its
low bits zero, so an insertion or removal only disturbs the chunk around it. Chunks whose digest occurs in both
snapshots of a pair are discarded; only rows of the remaining chunks are joined by key and classified.

Rows are shuffled once, by series and range of keys, so that all snapshots of a range lie together: sorting, chunking,
matching and classifying need no further exchange. Ranges are as many as the rows of a series need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.session import cut

#: A chunk has this many rows on average (a power of two).
CHUNK_ROWS = 32
#: Snapshot headers are broadcast up to this many (about 16 bytes each), and joined by a shuffle beyond.
BROADCAST_SNAPSHOTS = 500_000
#: A series with more rows than this in all its snapshots is sorted in several independent buckets of the key space.
BUCKET_ROWS = 100_000


def instant(text: Column) -> Column:
    """The instant of an ISO 8601 text in any offset and spelling; null if it is none. No offset means UTC."""
    t = F.upper(F.regexp_replace(text, r"^\s+|\s+$", ""))
    t = F.regexp_replace(t, r"^(\d{4})(\d{2})(\d{2})T", "$1-$2-$3T")
    t = F.regexp_replace(t, r"T(\d{2})(\d{2})(\d{2})?(?=$|[Z+.,-])", "T$1:$2:$3")
    t = F.regexp_replace(F.regexp_replace(t, r",(?=\d)", "."), r"\s*(UTC|GMT|Z)$", "Z")
    t = F.regexp_replace(t, r"(?<=[T ]\d\d:\d\d[\d:.]{0,16})\s*([+-]\d{2}):?(\d{2})$", "$1:$2")
    t = F.regexp_replace(t, r"(?<=[T ]\d\d:\d\d[\d:.]{0,16})\s*([+-]\d{2})$", "$1:00")
    t = F.regexp_replace(t, r"([T ]\d{2}:\d{2})(?=$|[Z+-])", "$1:00")
    return F.when(t.rlike(r"(Z|[+-]\d{2}:\d{2})$"), t.try_cast("timestamp")).otherwise(
        F.concat(t, F.when(t.rlike("[T ]"), "Z").otherwise("T00:00:00Z")).try_cast("timestamp")
    )


def map_entries_set(column: Column) -> Column:
    """A map as a sorted array of entries, null as the empty one; equal for equal sets of entries."""
    entries = F.transform(
        F.map_entries(column), lambda e: F.struct(e["key"].alias("k"), e["value"].isNull().alias("n"), e["value"].alias("v"))
    )
    return F.coalesce(F.array_sort(entries), F.array().cast("array<struct<k:string,n:boolean,v:string>>"))


def string_set(column: Column) -> Column:
    """An array as a sorted array of its distinct values, null as the empty one."""
    return F.coalesce(F.array_sort(F.array_distinct(column)), F.array().cast("array<string>"))


def digest(seed: int, *columns: Column, arrays: tuple[Column, ...] = ()) -> Column:
    """A 64-bit digest that tells null from any value and keeps neighbouring arrays apart."""
    parts = [F.lit(seed)]
    for c in columns:
        parts += [c.isNull(), c]
    for a in arrays:
        parts += [F.size(a), a]
    return F.xxhash64(*parts)


def consecutive(headers: DataFrame, snapshot: str, series: str, at: Column, arrived: str) -> DataFrame:
    """(snapshot, series, earlier, later) of every snapshot; repeated headers count once, the last to arrive holds.

    Snapshots of a series are ordered by ``at``, ties by snapshot id; an unreadable ``at`` comes first.
    """
    once = headers.filter(F.col(snapshot).isNotNull()).select(
        F.col(snapshot).alias("snapshot"), F.struct(F.col(arrived).alias("a"), at.alias("at"), F.col(series).alias("series")).alias("h")
    )
    once = once.groupBy("snapshot").agg(F.max("h").alias("h")).select("snapshot", "h.series", "h.at")
    order = Window.partitionBy("series").orderBy(F.col("at").asc_nulls_first(), "snapshot")
    return once.select(
        "snapshot", "series", F.lag("snapshot").over(order).alias("earlier"), F.lead("snapshot").over(order).alias("later")
    )


def snapshot_changes(
    records: DataFrame, snapshots: DataFrame, *, chunk_rows: int = CHUNK_ROWS, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Records added, removed or changed in each snapshot against the one before it.

    ``records``: (snapshot, kind, record_key, key_digest, d1, d2), d1 and d2 digests of the content. Rows whose
    snapshot is not in ``snapshots`` (see ``consecutive``) are dropped. Repeated rows count once; rows of one key
    that differ within a snapshot form one record, whose content is the set of them. A snapshot without rows
    removes everything. Returns (snapshot, kind, record_key, change); empty inputs give no rows.
    """
    counts = records.groupBy("snapshot").agg(F.count(F.lit(1)).alias("n"))
    series = F.xxhash64(F.lit(5), F.col("series").isNull(), "series")
    sized = snapshots.withColumn("series", series).join(counts, "snapshot", "left")
    buckets = sized.groupBy("series").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.coalesce("n", F.lit(0))) / bucket_rows)).cast("int").alias("buckets"))
    known = cut(sized.join(buckets, "series").select("snapshot", "earlier", "later", "series", "buckets"))
    if known.count() <= BROADCAST_SNAPSHOTS:
        known = F.broadcast(known)
    # a place holds one range of keys of all snapshots of a series: all that follows stays where this one shuffle puts it
    bucket = F.pmod(F.shiftright("key_digest", 8), F.col("buckets"))
    rows = (
        records.join(known.select("snapshot", "series", "buckets"), "snapshot")
        .select(F.xxhash64("series", "kind", bucket).alias("place"), "snapshot", "kind", "record_key", "key_digest", "d1", "d2")
        .repartition("place")
        .dropDuplicates(["place", "snapshot", "kind", "record_key", "key_digest", "d1", "d2"])
        .groupBy("place", "snapshot", "kind", "record_key", "key_digest")
        .agg(F.bit_xor("d1").alias("d1"), F.bit_xor("d2").alias("d2"))
    )
    order = Window.partitionBy("place", "snapshot", "kind").orderBy("record_key", "key_digest")
    starts = F.col("key_digest").bitwiseAND(F.lit(chunk_rows - 1)) == 0
    rows = rows.withColumn(
        "chunk", F.coalesce(F.last(F.when(starts, F.col("key_digest")), ignorenulls=True).over(order), F.lit(0).cast("long"))
    )
    chunks = rows.groupBy("place", "snapshot", "kind", "chunk").agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64(F.lit(3), "record_key", "key_digest", "d1")).alias("c1"),
        F.bit_xor(F.xxhash64(F.lit(4), "record_key", "key_digest", "d2")).alias("c2"),
        F.collect_list(F.struct("record_key", "key_digest", "d1", "d2")).alias("members"),
    )
    sides = F.filter(
        F.array(
            F.struct(F.when(F.col("earlier").isNotNull(), F.col("snapshot")).alias("pair"), F.lit(1).alias("side")),
            F.struct(F.col("later").alias("pair"), F.lit(0).alias("side")),
        ),
        lambda s: s["pair"].isNotNull(),
    )
    delivered = chunks.join(known.select("snapshot", "earlier", "later"), "snapshot").select("place", "kind", "n", "c1", "c2", "members", F.inline(sides))
    unmatched = (
        delivered.groupBy("place", "pair", "kind", "n", "c1", "c2")
        .agg(F.min("side").alias("side"), F.max("side").alias("last"), F.first("members").alias("members"))
        .filter(F.col("side") == F.col("last"))
    )
    suspects = unmatched.select("place", "pair", "side", "kind", F.inline("members"))
    was, now = F.col("side") == 0, F.col("side") == 1
    states = suspects.groupBy("place", "pair", "kind", "record_key", "key_digest").agg(
        *(F.max(F.when(on, F.col(d))).alias(f"{d}_{name}") for d in ("d1", "d2") for on, name in ((was, "was"), (now, "now")))
    )
    change = (
        F.when(F.col("d1_was").isNull(), "added")
        .when(F.col("d1_now").isNull(), "removed")
        .when((F.col("d1_was") != F.col("d1_now")) | (F.col("d2_was") != F.col("d2_now")), "changed")
    )
    return states.select(F.col("pair").alias("snapshot"), "kind", "record_key", change.alias("change")).filter("change is not null")


def graph_records(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows of scanned graphs as ``snapshot_changes`` takes them; rows without id or source are no records."""
    node_content = dict(
        columns=[F.col(c) for c in ("name", "type", "file_path", "line_number")], arrays=(map_entries_set(F.col("metadata")),)
    )
    edge_content = dict(columns=[F.col("confidence")], arrays=(string_set(F.col("evidence")), map_entries_set(F.col("metadata"))))

    def shape(df: DataFrame, kind: str, shown: Column, key: list[Column], content: dict) -> DataFrame:
        return df.select(
            F.col("scan_id").alias("snapshot"), F.lit(kind).alias("kind"), shown.alias("record_key"), digest(0, *key).alias("key_digest"),
            digest(1, *content["columns"], arrays=content["arrays"]).alias("d1"),
            digest(2, *content["columns"], arrays=content["arrays"]).alias("d2"),
        )

    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    shown = F.concat(F.col("source"), F.lit(" -> "), blank("target"), F.lit(" ("), blank("type"), F.lit(")"))
    return shape(nodes.filter("id is not null and scan_id is not null"), "node", F.col("id"), [F.col("id")], node_content).unionByName(
        shape(edges.filter("source is not null and scan_id is not null"), "edge", shown, [F.col(c) for c in ("source", "target", "type")], edge_content)
    )


def scan_changes(scans: DataFrame, nodes: DataFrame, edges: DataFrame, **options: int) -> DataFrame:
    """All changes between consecutive scans of a repository: (scan_id, kind, record_key, change)."""
    snapshots = consecutive(scans, "scan_id", "repo", instant(F.col("scan_timestamp")), "received_at")
    return snapshot_changes(graph_records(nodes, edges), snapshots, **options).withColumnRenamed("snapshot", "scan_id")
