"""Audit logs as streams: windowed counts and first-write-wins, with bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(stream: DataFrame, ts: str, by: list[str], every: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """begin, the columns by, n: rows in each window; rows later than late are dropped and their windows' state freed."""
    counted = stream.withWatermark(ts, late).groupBy(F.window(ts, every), *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("begin"), *by, "n")


def first_writes(stream: DataFrame, ts: str, key: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key among rows that arrive within late of each other; later copies go."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
