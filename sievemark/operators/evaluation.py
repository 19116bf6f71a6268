"""Evaluation of predictions against gold labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rate(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, gold: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def dense_confusion(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """All pairs of labels seen on either side, zeros included. The labels are few; the counts are aggregated first."""
    counts = confusion(df, gold, pred)
    labels = counts.select(F.explode(F.array("gold", "pred")).alias("label")).distinct()
    pairs = labels.withColumnRenamed("label", "gold").crossJoin(F.broadcast(labels.withColumnRenamed("label", "pred")))
    return pairs.join(counts, ["gold", "pred"], "left").fillna(0, ["n"])


def prf(df: DataFrame, gold: str, pred: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Precision, recall, F1 and support of each label that is gold or predicted, from the aggregated confusion counts."""
    counts = df.groupBy(*by, F.col(gold).alias("g"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    sides = F.array(F.struct(F.col("g").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("g") == F.col("p"), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp")))
    sums = counts.select(*by, F.explode(sides).alias("s")).groupBy(*by, "s.label").agg(*(F.sum(f"s.{c}").alias(c) for c in ("support", "predicted", "tp")))
    precision, recall = rate(F.col("tp"), F.col("predicted")), rate(F.col("tp"), F.col("support"))
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return sums.select(*by, "label", "support", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def set_scores(gold: Column, pred: Column) -> dict[str, Column]:
    """Scores of two arrays of distinct items; two empty sets have Jaccard 0 (and are exact)."""
    hits = F.size(F.array_intersect(gold, pred))
    precision, recall = rate(hits, F.size(pred)), rate(hits, F.size(gold))
    return {
        "exact": F.size(F.array_except(gold, pred)) + F.size(F.array_except(pred, gold)) == 0,
        "precision": precision, "recall": recall,
        "f1": F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0),
        "jaccard": rate(hits, F.size(F.array_union(gold, pred))),
    }


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts by the values of each column alone: one pass that gives a row to each cell, counted before the shuffle."""
    expanded = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns))).alias("d"))
    return expanded.groupBy("d.dimension", "d.value").agg(F.count("*").alias("n"))
