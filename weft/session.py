"""Session helpers: sessions for tests, table reads and lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("weft")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder lineage is cut into.

    A cluster names a shared folder in ``spark.checkpoint.dir`` and fails without; only where that is unset on one
    machine, as in tests, is a temporary folder made. Spark removes the files of data that is not used any more where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set, as ``local_session`` does.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="weft-checkpoint-"))
    return named or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from the shared checkpoint folder.

    The files survive the loss of any executor, and loops that call this keep plans of constant size.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_observed(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """As ``cut``, with aggregates of ``df`` that come from the same job; ``rows`` is always among them."""
    seen = Observation()
    kept = cut(df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in metrics.items())))
    return kept, seen.get
