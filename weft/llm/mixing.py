"""Mixing sources to target weights by Poisson replication.

Sizes in tokens are summed per source. A source needs ``rate = share * total / size`` copies of each document on
average. Each document gets a count by inverting a Poisson distribution at a hash-seeded uniform number, cut off at
the largest number of repeats; the Poisson mean is solved so that the mean of the cut-off counts is the rate. Where the
rate exceeds the cap, every document is taken as often as allowed and the shortfall is reported. Whole documents are
exploded by their counts and shuffled globally by a hash.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.session import cut

#: Folder of the public tokenizers' files, on every machine.
TOKENIZER_DIR = os.environ.get("WEFT_TOKENIZERS", "/opt/tokenizers")
#: Ranks of a byte-level BPE vocabulary.
TOKENIZER_FILE = "byte_bpe_50k.tiktoken"
#: How the vocabulary's texts are cut into words before merging; fixed by the vocabulary.
TOKENIZER_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@lru_cache(maxsize=1)
def _encoding(folder: str, name: str):
    import tiktoken

    with open(os.path.join(folder, name), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=TOKENIZER_PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_sizes(documents: DataFrame, keys: list[str], *, text: str = "text", folder: str = TOKENIZER_DIR, name: str = TOKENIZER_FILE) -> DataFrame:
    """``keys`` and ``tokens``, the length of the whole text in tokens; a null or empty text has 0."""
    shape = documents.select(*keys, text)
    schema = ", ".join(f"`{k}` {shape.schema[k].dataType.simpleString()}" for k in keys) + ", tokens long"

    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(folder, name)
        for batch in batches:
            counts = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], names=[*keys, "tokens"])

    return shape.mapInArrow(size, schema)


def source_name(column: Column) -> Column:
    """Sources are compared without white space around them and in lower case."""
    return F.lower(F.regexp_replace(column, r"(?U)^\s+|\s+$", ""))


def _probabilities(mean: float, cap: int) -> list[float]:
    """P(count = k) for k below ``cap``, by logarithms, so that large means do not vanish."""
    if mean <= 0:
        return [1.0, *[0.0] * (cap - 1)][:cap]
    return [math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in range(cap)]


def capped_mean(mean: float, cap: int) -> float:
    """The mean of a Poisson count cut off at ``cap``."""
    below = _probabilities(mean, cap)
    return sum(k * p for k, p in enumerate(below)) + cap * max(0.0, 1.0 - sum(below))


def poisson_mean(rate: float, cap: int) -> float:
    """The Poisson mean whose counts, cut off at ``cap``, have the mean ``rate``; infinite from the cap on."""
    if rate >= cap:
        return math.inf
    if rate <= 0:
        return 0.0
    low, high = 0.0, 1.0
    while capped_mean(high, cap) < rate:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if capped_mean(middle, cap) < rate else (low, middle)
    return high


def steps(mean: float, cap: int) -> list[float]:
    """P(count <= k) for k below ``cap``: a count is the number of steps that a uniform number reaches."""
    if math.isinf(mean):
        return [0.0] * cap
    return [min(1.0, below) for below in accumulate(_probabilities(mean, cap))]


class Mixture:
    """A corpus mixed from sources by target shares.

    ``documents`` need ``key``, ``source`` and ``text``; ``targets`` (source, target_share, max_repeats) is a small
    configuration table. Its rows and one total per target, never documents, come to the driver. Sources no target names
    give no documents but count in the total. A target named twice is an error; null shares or caps count as 0.
    ``total`` defaults to the size of all documents. Rows with the same key get the same count.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, *, key: str = "doc_id", source: str = "source", text: str = "text",
                 seed: int = 7, total: int | None = None, folder: str = TOKENIZER_DIR, name: str = TOKENIZER_FILE):
        self.key, self.seed, self.source, self.text = key, seed, source, text
        self.documents, self.folder, self.name = documents, folder, name
        self.goals = targets.filter("source is not null").select(
            source_name(F.col("source")).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"),
            F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).cast("int").alias("max_repeats"),
        )
        named = documents.select(F.col(key), F.col(text).alias("text"), source_name(F.col(source)).alias("source"))
        self.sizes = cut(token_sizes(named, [key, "source"], folder=folder, name=name))  # texts are tokenised once
        self._total = total

    def plan(self) -> DataFrame:
        """(source, target_share, max_repeats, documents, tokens, wanted, rate, mean, steps), one row a target."""
        per_source = self.sizes.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"))
        goals = self.goals.withColumn("named", F.lit(True))
        # one row for each target and one for everything else, so bounded by the configuration
        rows = per_source.join(F.broadcast(goals), "source", "full").groupBy(F.when(F.col("named"), F.col("source")).alias("source")).agg(
            F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"), F.count_if("named").alias("times"),
            F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        ).collect()
        if any(r["source"] is not None and r["times"] > 1 for r in rows):
            raise ValueError("a source has several targets")
        total = self._total if self._total is not None else sum(r["tokens"] for r in rows)
        out = []
        for r in rows:
            if r["source"] is None:
                continue
            wanted = r["target_share"] * total
            rate = wanted / r["tokens"] if r["tokens"] else (math.inf if wanted > 0 else 0.0)
            mean = poisson_mean(rate, r["max_repeats"])
            out.append((r["source"], r["target_share"], r["max_repeats"], r["documents"], r["tokens"], wanted, rate, mean, steps(mean, r["max_repeats"])))
        return self.goals.sparkSession.createDataFrame(
            out, "source string, target_share double, max_repeats int, documents long, tokens long, wanted double, rate double, mean double, steps array<double>"
        )

    def counts(self, plan: DataFrame) -> DataFrame:
        """(key, source, tokens, max_repeats, copies): how often each document of a named source is taken, 0 included."""
        chosen = self.sizes.join(F.broadcast(plan.select("source", "max_repeats", "steps")), "source")
        return chosen.select(self.key, "source", "tokens", "max_repeats", self._copies(F.col(self.key), F.col("steps")).alias("copies"))

    def _copies(self, key: Column, steps: Column) -> Column:
        uniform = (F.pmod(F.xxhash64(F.lit(self.seed), key), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
        return F.size(F.filter(steps, lambda s: s <= uniform))

    def report(self) -> DataFrame:
        """(source, target_share, actual_share, documents, taken, tokens, wanted, mixed_tokens, short), one row a target.

        ``taken`` counts documents with their repeats, ``mixed_tokens`` their tokens; ``actual_share`` is of the mixed
        corpus. ``short`` comes from the counted mixture: every document of the source is taken as often as allowed, and
        its tokens still fall behind the share. A source without documents is short of any share above 0.
        """
        plan = self.plan()
        mixed = self.counts(plan).groupBy("source").agg(
            F.sum("copies").alias("taken"), F.sum(F.col("copies") * F.col("tokens")).alias("mixed_tokens"), F.min(F.col("copies") >= F.col("max_repeats")).alias("spent"),
        )
        joined = plan.join(mixed, "source", "left").fillna(0, ["taken", "mixed_tokens"])
        whole = mixed.agg(F.sum("mixed_tokens")).scalar()
        return joined.select(
            "source", "target_share", F.coalesce(F.try_divide(F.col("mixed_tokens"), whole), F.lit(0.0)).alias("actual_share"), "documents", "taken", "tokens",
            "wanted", "mixed_tokens", (F.coalesce("spent", F.lit(True)) & (F.col("mixed_tokens") < F.col("wanted"))).alias("short"),
        )

    def corpus(self) -> DataFrame:
        """The mixed corpus in its global order: place, copy, source, tokens and every column of ``documents``.

        Rows are sorted by ``place``, a hash that shuffles them; it is no running number. Every copy is a row of its own with the whole document. ``source`` is the name that was compared. A column of
        ``documents`` with one of the first four names, as its source, is called ``document_`` and its name.
        """
        own, names = ("place", "copy", "source", "tokens"), {}
        for column in self.documents.columns:
            name = column
            while name.lower() in own or (name != column and name.lower() in map(str.lower, self.documents.columns)):
                name = f"document_{name}"
            names[column] = name
        key, text = names[self.key], names[self.text]
        whole = self.documents.toDF(*names.values()).withColumn("source", source_name(F.col(names[self.source])))
        # counts follow from key and source, so texts are not joined to them; only taken texts are shuffled, once
        goals = self.plan().select("source", F.col("steps").alias("_steps"))
        copies = self._copies(F.col(key), F.col("_steps"))
        taken = whole.join(F.broadcast(goals), "source").withColumn("copy", F.explode(F.sequence(F.lit(0), copies))).filter("copy > 0")
        placed = taken.withColumn("place", F.xxhash64(F.lit(self.seed + 1), F.col(key), F.col("copy"))).sort("place", key, "copy")
        folder, name = self.folder, self.name

        @F.arrow_udf("long")
        def tokens(texts: pa.Array) -> pa.Array:
            encoding = _encoding(folder, name)
            return pa.array([len(encoding.encode_ordinary(t)) if t else 0 for t in texts.to_pylist()], pa.int64())

        return placed.select("place", "copy", "source", tokens(text).alias("tokens"), *names.values())
