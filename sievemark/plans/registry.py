"""All queries of the library's own operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cells, checking, contracting, controlling, digital, tokens, evaluating, fields, gridding, joining, linking, modelling, quantising, ranking, retrieving, summarising, validating  # noqa: F401  (they register their queries)
from .query import QUERIES, SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["label_scores"](spark, sf_dir)
