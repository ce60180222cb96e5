"""Per-key results over joins in which a few keys hold most rows.

Both inputs are aggregated by join key before they meet, the compact states are joined, counts are multiplied or
sums combined algebraically, and the states are rolled up. No task ever sees the raw rows of one key: each
aggregation starts on the map side, so a key with a third of all rows costs one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.session import cut

#: A key is heavy from this share of all rows on.
HEAVY_SHARE = 0.04


def compact_states(rows: DataFrame, group_key: str, join_key: str, value: str) -> DataFrame:
    """(key, join_key, value, by_value, n): rows of each key per join key, and per value, from one scan.

    Both are grouping sets of one aggregation, so the table is read and shuffled once. Rows with a null key are left
    out. The states are written to the checkpoint folder, as several results are rolled up from them.
    """
    shape = rows.select(F.col(group_key).alias("key"), F.col(join_key).alias("join_key"), F.col(value).alias("value")).filter("key is not null")
    sets = shape.groupingSets([[F.col("key"), F.col("join_key")], [F.col("key"), F.col("value")]], F.col("key"), F.col("join_key"), F.col("value"))
    return cut(sets.agg((F.grouping("join_key") == 1).alias("by_value"), F.count(F.lit(1)).alias("n")))


def join_counts(states: DataFrame, right: DataFrame, join_key: str) -> DataFrame:
    """Counts of the join of a table with ``right`` per key, from the table's states, without making the join's rows.

    Returns (key, rows, joined_rows, join_keys, matched_join_keys): rows of the table, rows of the join, distinct join
    keys in the table, and those that ``right`` has. A null join key counts as a row and joins nothing. Repeated rows
    multiply, as in the plain join.
    """
    left = states.filter("not by_value").select("key", "join_key", "n")
    other = right.filter(F.col(join_key).isNotNull()).groupBy(F.col(join_key).alias("join_key")).agg(F.count(F.lit(1)).alias("m"))
    return left.join(other, "join_key", "left").groupBy("key").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0)).cast("long").alias("joined_rows"),
        F.count("join_key").alias("join_keys"), F.count(F.when(F.col("m").isNotNull(), F.col("join_key"))).alias("matched_join_keys"),
    )


def key_profile(rows: DataFrame, dimension: DataFrame, *, key: str, join_key: str, value: str, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """All keys with their rows, distinct join keys and values, share of all rows and whether they are heavy.

    Returns (key_value, rows, joined_rows, join_keys, matched_join_keys, values, share, heavy). The share is of the
    rows whose key is not null, as delivered. No rows give an empty result. The profile is computed once and written to
    the checkpoint folder, so that heavy keys and everything else that is read from it come out of the same states.
    """
    states = compact_states(rows, key, join_key, value)
    spread = states.filter("by_value").groupBy("key").agg(F.count("value").alias("values"))
    share = F.col("rows") / states.filter("not by_value").agg(F.sum("n")).scalar()
    profile = join_counts(states, dimension, join_key).join(spread, "key")
    return cut(
        profile.select(
            F.col("key").alias("key_value"), "rows", "joined_rows", "join_keys", "matched_join_keys", "values", share.alias("share"), (share >= heavy_share).alias("heavy"),
        )
    )
