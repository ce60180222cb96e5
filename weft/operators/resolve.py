"""Finding the node that a text means, and suggestions where none is meant."""

from __future__ import annotations

import difflib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.errors import AmbiguousNode, NodeNotFound

#: Suggestions that are offered, and the similarity from which on; fixed values.
SUGGESTIONS, SIMILARITY = 5, 0.45


#: What is told of a candidate or suggestion.
SHOWN = ("id", "name", "type", "file_path")


def match_stages(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, stage, matches, id): of each query the first stage with a match, how many match there, and the smallest id.

    Stages: 1 id, 2 identity (the id after its type), 3 name, 4 name in any case, 5 identity ends with ``.query``, 6 last
    part after a colon, 7 the same in any case. Queries without any match are left out. Each stage is
    one key of a node, so a batch of queries is one equi-join with the exploded keys; suffixes of dotted identities are keys too.
    """
    identity = F.regexp_replace("id", r"^[^:]*:", "")
    parts = F.split(identity, r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    last = F.regexp_extract("id", r"([^:]*)$", 1)
    ends = F.transform(F.sequence(F.lit(2), F.size(F.split("id", ":"))), lambda i: F.array_join(F.slice(F.split("id", ":"), i, 1000), ":"))
    key = lambda stage, column: F.struct(F.lit(stage).alias("stage"), column.alias("key"))
    keys = F.concat(
        F.array(key(1, F.col("id")), key(2, identity), key(3, F.col("name")), key(4, F.lower("name"))),
        F.transform(tails, lambda t: key(5, t)),
        F.when(F.col("id").contains(":"), F.transform(ends, lambda t: key(6, t))).otherwise(F.array(key(6, last))),
        F.array(key(7, F.lower(last))),
    )
    table = nodes.select("id", F.inline(keys)).distinct()
    asked = queries.select(F.trim("query").alias("query")).filter("query <> ''").distinct()
    folded = F.transform(F.sequence(F.lit(1), F.lit(7)), lambda s: F.struct(s.alias("stage"), F.when(s.isin(4, 7), F.lower("query")).otherwise(F.col("query")).alias("key")))
    hits = asked.select("query", F.inline(folded)).join(table, ["stage", "key"]).groupBy("query", "stage").agg(
        F.count_distinct("id").alias("matches"), F.min("id").alias("id")
    )
    return hits.groupBy("query").agg(F.min(F.struct("stage", "matches", "id")).alias("b")).select("query", "b.*")


def suggest(nodes: DataFrame, query: str, limit: int = SUGGESTIONS, cutoff: float = SIMILARITY) -> DataFrame:
    """(id, similarity): the nodes whose id or name is most like the query, best first; at most ``limit``.

    Twice as many labels as nodes are ranked before labels of the same node are put together.
    """
    needle = query.strip()

    @F.pandas_udf("double")
    def ratio(texts):
        matcher = difflib.SequenceMatcher()
        matcher.set_seq2(needle)

        def score(text: str) -> float:
            matcher.set_seq1(text)
            if matcher.real_quick_ratio() < cutoff or matcher.quick_ratio() < cutoff:
                return 0.0
            return matcher.ratio()

        return texts.map(score)

    labels = nodes.select("id", F.explode(F.array("id", "name")).alias("label")).filter("label is not null").groupBy("label").agg(F.min("id").alias("id"))
    best = labels.withColumn("similarity", ratio("label")).filter(F.col("similarity") >= cutoff).orderBy(F.col("similarity").desc(), F.col("label").desc()).limit(2 * limit)
    return best.groupBy("id").agg(F.max("similarity").alias("similarity")).orderBy(F.col("similarity").desc(), "id").limit(limit)


def resolve(nodes: DataFrame, query: str) -> str:
    """The id that ``query`` means; raises ``AmbiguousNode`` or ``NodeNotFound``."""
    asked = nodes.sparkSession.createDataFrame([(query,)], "query string")
    hit = match_stages(nodes, asked).first()
    if hit is None:
        blank = not query.strip()
        raise NodeNotFound(query, [] if blank else suggestions(nodes, query))
    if hit["matches"] > 1:
        raise AmbiguousNode(query, candidates(nodes, query, hit["stage"]))
    return hit["id"]


def suggestions(nodes: DataFrame, query: str) -> list[dict]:
    """The suggested nodes, best first, as dicts of ``SHOWN``."""
    best = [r["id"] for r in suggest(nodes, query).collect()]
    rows = {r["id"]: r.asDict() for r in nodes.filter(F.col("id").isin(best)).select(*SHOWN).collect()} if best else {}
    return [rows[i] for i in best]


def candidates(nodes: DataFrame, query: str, stage: int) -> list[dict]:
    """The nodes that match at a stage, for the message, as dicts of ``SHOWN``."""
    q = query.strip()
    identity, last = F.regexp_replace("id", r"^[^:]*:", ""), F.regexp_extract("id", r"([^:]*)$", 1)
    tests = {
        1: F.col("id") == q, 2: identity == q, 3: F.col("name") == q, 4: F.lower("name") == q.lower(),
        5: (identity == q) | F.endswith(identity, F.lit("." + q)), 6: F.endswith(F.col("id"), F.lit(":" + q)) | (last == q),
        7: F.lower(last) == q.lower(),
    }
    return [r.asDict() for r in nodes.filter(tests[stage]).select(*SHOWN).orderBy("id").collect()]
