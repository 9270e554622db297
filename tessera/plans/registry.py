"""Queries over the driver tables, one or more per operator family, and SQL with the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as a query under its own name."""

    def put(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def uuid5_sql(name: str) -> str:
    """SQL of the version 5 identifier of a name in the URL name space."""
    d = f"sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({name}))"
    digit = f"substr('89ab89ab89ab89ab', position(substr({d}, 17, 1) IN '0123456789abcdef'), 1)"
    return f"concat(substr({d}, 1, 8), '-', substr({d}, 9, 4), '-5', substr({d}, 14, 3), '-', {digit}, substr({d}, 18, 3), '-', substr({d}, 21, 12))"


def _load() -> None:
    from . import curation_queries, extraction_queries, graph_queries, relational_queries, storage_queries, text_queries, vector_queries  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def entry(spark: SparkSession) -> DataFrame:
    """Hybrid retrieval on the smallest tables."""
    return queries()["hybrid_retrieve"](spark, "/root/testdata/sf0.001")
