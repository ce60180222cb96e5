"""All queries of the core library and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weft.plans import extraction_queries, graph_queries, training_queries

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (training_queries, graph_queries, extraction_queries)


def core_queries() -> dict[str, Query]:
    return {name: query for m in _MODULES for name, query in m.QUERIES.items()}


def core_oracle() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
