"""Source files that do not parse, flagged per file and counted per repository and language."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.grammar import sql
from weft.llm.syntax import python, yaml


def language(path: Column) -> Column:
    """The language of a path's suffix in any case; null for others."""
    suffix = F.lower(F.regexp_extract(path, r"(?i)\.(py|sql|yml|yaml)\s*$", 1))
    return F.when(suffix == "py", "python").when(suffix == "sql", "sql").when(suffix.isin("yml", "yaml"), "yaml")


def accepted_dialects(name: str, text: str) -> list[str]:
    """The dialects of a language that accept the whole text."""
    if name == "sql":
        bits = sql.dialects(text)
        return [d for i, d in enumerate(sql.DIALECTS) if bits >> i & 1]
    if name == "yaml":
        return ["yaml"] if yaml.accepts(text) else []
    return ["python"] if python.accepts(text) else []


def check_files(files: DataFrame, *, keys: tuple[str, ...] = ("file_id", "repo"), path: str = "file_path", content: str = "content") -> DataFrame:
    """The key columns, language, dialects that accept the file, and ``invalid``; one row per file of a known language.

    All dialect grammars of a language run together over one graph-structured stack; a file is invalid if every one
    rejects it. A null or empty content is valid. Texts are parsed whole, each task on its own, so copies or very long
    files concern one row at a time; rows are spread evenly by key first because parsing, not reading, takes the time.
    """
    spark = files.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    named = files.select(*(F.col(k) for k in keys), language(F.col(path)).alias("language"), F.col(content).alias("content"))
    known = named.filter("language is not null").repartition(parts, F.xxhash64(*keys, "content"))
    n = len(keys)
    schema = ", ".join(f"`{k}` {named.schema[k].dataType.simpleString()}" for k in keys) + ", language string, dialects array<string>, invalid boolean"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [accepted_dialects(name, text.as_py() or "") for name, text in zip(batch.column(n).to_pylist(), batch.column(n + 1))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: n + 1], pa.array(found, pa.list_(pa.string())), pa.array([not v for v in found], pa.bool_())],
                names=[*keys, "language", "dialects", "invalid"],
            )

    return known.mapInArrow(parse, schema)


def rates(checked: DataFrame) -> DataFrame:
    """(repo, language, files, invalid, rate) of checked files."""
    return checked.groupBy("repo", "language").agg(
        F.count(F.lit(1)).alias("files"), F.count_if("invalid").alias("invalid"), F.avg(F.col("invalid").cast("double")).alias("rate")
    )
