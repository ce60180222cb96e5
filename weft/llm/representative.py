"""The best representative of each group of duplicate records, field by field.

Fields are unpivoted to long rows. Each row votes for its normalised value with the trust in its source times a decay by
age; votes are summed per group, field and value. ``max_by`` picks the winner of each group and field from that tally,
either by votes or by a stated order of the values' best rows, and the winners are pivoted back into one record. All steps are aggregations that
combine on the map side, so a group with a third of all rows is one partial state per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An observation loses half its weight in this many days.
HALF_LIFE_DAYS = 90.0

_SPACE = r"(?U)^\s+|\s+$"


def _strip(column: Column) -> Column:
    return F.regexp_replace(column, _SPACE, "")


def canonical_id(column: Column) -> Column:
    """A node id in canonical form; null stays null.

    White space goes around the id and its ``:``-separated parts; names of sql_table lose quotes, brackets and white
    space around each dotted part and are lower-cased; an api_route has an upper-case method and a path with a leading
    ``/``; an external_system is its lower-case host. Everything else stays as it is.
    """
    parts = F.transform(F.split(_strip(column), ":", -1), _strip)
    kind, rest = F.element_at(parts, 1), F.array_join(F.slice(parts, 2, 1_000_000), ":")
    quotes = r"(?U)^[\s`'\"\[\]]+|[\s`'\"\[\]]+$"
    name = F.array_join(F.transform(F.split(rest, r"\.", -1), lambda p: F.lower(F.regexp_replace(p, quotes, ""))), ".")
    path = F.array_join(F.slice(parts, 3, 1_000_000), ":")
    route = F.concat_ws(":", F.upper(F.try_element_at(parts, F.lit(2))), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)))
    host = F.regexp_replace(F.lower(rest), r"(?U)^\s*[a-z][a-z0-9+.-]*:\s*//", "")
    host = F.regexp_replace(F.regexp_replace(host, r"^//", ""), r"[/?#].*$", "")
    host = F.regexp_replace(host, r"^.*@", "")
    host = _strip(F.when(host.startswith("["), F.regexp_replace(host, r"^\[([^\]]*)\].*$", "$1")).otherwise(F.regexp_replace(host, r":.*$", "")))
    shaped = F.when(kind == "sql_table", name).when((kind == "api_route") & (F.size(parts) > 2), route).when(kind == "api_route", F.upper(rest)).when(kind == "external_system", host).otherwise(rest)
    return F.when(F.size(parts) > 1, F.concat(kind, F.lit(":"), shaped)).otherwise(kind)


def filled_values(metadata: Column) -> Column:
    """How many values of a map are neither null nor only white space; 0 for a null map."""
    return F.coalesce(F.size(F.filter(F.map_values(metadata), lambda v: v.isNotNull() & v.rlike(r"(?U)\S"))), F.lit(0))


def unpivot_facts(facts: DataFrame, trust: DataFrame) -> DataFrame:
    """Long rows (repo, node, fact_id, field, value, usable, filled, trust, emitted_at) of node facts.

    ``value`` is the normalised value as text. Every fact gives a row for each of the three fields, so that groups can be
    counted on them. ``trust`` (parser, trust) is broadcast: it has a row per parser, a parser named twice has the larger
    trust. Facts without an id describe no node.
    """
    known = trust.filter("parser is not null").groupBy("parser").agg(F.max("trust").alias("_trust"))
    parser = F.col("metadata")
    path = _strip(F.col("file_path"))
    entries = F.array_sort(F.transform(F.map_entries(parser), lambda e: F.struct(e["key"].alias("key"), F.coalesce(e["value"], F.lit("null")).alias("value"))))
    filled = filled_values(parser)
    fields = F.array(
        F.struct(F.lit("file_path").alias("field"), path.alias("value"), path.rlike(r"(?i)\.(py|sql|yml|yaml)$").alias("usable"), F.lit(0).alias("filled")),
        F.struct(F.lit("line_number").alias("field"), F.col("line_number").cast("string").alias("value"), (F.col("line_number") > 0).alias("usable"), F.lit(0).alias("filled")),
        F.struct(F.lit("metadata").alias("field"), F.to_json(entries).alias("value"), (filled > 0).alias("usable"), filled.alias("filled")),
    )
    rows = facts.filter("id is not null").select("repo", canonical_id(F.col("id")).alias("node"), "fact_id", "parser", "emitted_at", F.inline(fields))
    return rows.join(F.broadcast(known), "parser", "left").select(
        "repo", "node", "fact_id", "field", "value", F.coalesce("usable", F.lit(False)).alias("usable"), "filled",
        F.coalesce("_trust", F.lit(0)).alias("trust"), "emitted_at",
    )


def _key(seed: int, *columns: str) -> Column:
    """A 128-bit digest of columns that tells null from any value; equal rows have equal digests."""
    parts = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return F.struct(F.xxhash64(F.lit(seed), *parts).alias("h"), F.xxhash64(F.lit(seed + 1), *parts).alias("l"))


def tally(long: DataFrame, half_life_days: float = HALF_LIFE_DAYS) -> DataFrame:
    """(node_key, repo, node, field, value, votes, best, group_id, members): trust times recency decay, summed per value.

    Votes are whole millionths of a trust, so that sums do not depend on the order of rows. Age counts from the latest
    time of all facts; a null time has the weight 0 and an untrusted source a trust of 1, so that every value can win
    where nothing better exists. A value of unusable rows has null votes. ``best`` is the value's best usable row: most
    filled values, highest trust, latest time with null as the oldest, smallest ``fact_id``. Nodes and values are told
    apart by 128-bit digests, so that their texts are only shuffled where they are asked for.
    """
    micros = F.unix_micros(F.col("emitted_at").cast("timestamp"))
    newest = long.agg(F.max(micros)).scalar()
    age = (newest - micros) / F.lit(86_400_000_000.0)
    weight = F.coalesce(F.round((F.col("trust") + 1) * F.pow(F.lit(2.0), -age / half_life_days) * 1_000_000).cast("long"), F.lit(0).cast("long"))
    usable = F.col("usable")
    row = F.struct("filled", "trust", "emitted_at", (-F.col("fact_id")).alias("against"))
    return long.groupBy(_key(1, "repo", "node").alias("node_key"), "field", _key(3, "value").alias("value_key")).agg(
        F.min("repo").alias("repo"), F.min("node").alias("node"), F.min("value").alias("value"), F.sum(F.when(usable, weight)).alias("votes"),
        F.max(F.when(usable, row)).alias("best"), F.min("fact_id").alias("group_id"), F.count(F.lit(1)).alias("members"),
    )


def winners(tallied: DataFrame, by: str = "preference") -> DataFrame:
    """(node_key, repo, node, field, group_id, members, fact_id, value, votes): the winning value of each node and field.

    ``by="votes"``: the value with the most votes; ties go to the smallest value. ``by="preference"``: the value of the
    best row, in the order that ``tally`` states; votes are its last tie-break. ``fact_id`` is the best row of the
    winning value. A field without a usable row has a null winner. Repeated rows count as often as they come.
    """
    votes = F.col("votes")
    rank = F.struct((-votes).alias("against"), "value") if by == "votes" else F.struct("best", "votes")
    choose, rank = F.min_by if by == "votes" else F.max_by, F.when(votes.isNotNull(), rank)
    won = lambda c: choose(F.when(votes.isNotNull(), c), rank)
    return tallied.groupBy("node_key", "field").agg(
        F.min("repo").alias("repo"), F.min("node").alias("node"), F.min("group_id").alias("group_id"), F.sum("members").alias("members"),
        won(-F.col("best.against")).alias("fact_id"), won(F.col("value")).alias("value"), won(votes).alias("votes"),
    )


def disagreements(tallied: DataFrame) -> DataFrame:
    """(field, fields, differ): in how many nodes' fields the votes choose another value than the stated order."""
    key = ["node_key", "field"]
    one = lambda by: winners(tallied, by).filter("fact_id is not null").select(*key, "value")
    both = one("preference").unionByName(one("votes")).groupBy(*key).agg((F.min("value") != F.max("value")).alias("d"))
    return both.groupBy("field").agg(F.count(F.lit(1)).alias("fields"), F.count_if("d").alias("differ"))


def golden_records(winners: DataFrame) -> DataFrame:
    """(group_id, repo, node, members, file_path, line_number, metadata): winners pivoted back to one row a node."""
    of = lambda f: F.max(F.when(F.col("field") == f, F.col("value"))).alias(f)
    return winners.groupBy("node_key").agg(
        F.min("repo").alias("repo"), F.min("node").alias("node"), F.min("group_id").alias("group_id"), F.max("members").alias("members"), of("file_path"), of("line_number"), of("metadata")
    ).drop("node_key")
