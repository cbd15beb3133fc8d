"""All queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import analytics, index, search, suites

_ALL = {**search.QUERIES, **analytics.QUERIES, **index.QUERIES, **suites.QUERIES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_rerank_diversify(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: made for name, (made, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
