"""Multinomial Naive Bayes as three tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tables
from .written import written


@dataclass
class Model:
    """roles (role, prior as a log, floor: a missing term's log probability) and terms (role, term, gain over the floor)."""

    roles: DataFrame
    terms: DataFrame


def fit(rows: DataFrame, role: str, tokens: str) -> Model:
    each = rows.select(F.col(role).alias("role"), F.explode(tokens).alias("term")).groupBy("role", "term").agg(F.count("*").alias("n"))
    vocabulary = each.agg(F.count_distinct("term").alias("v"))
    docs = rows.groupBy(F.col(role).alias("role")).agg(F.count("*").alias("docs"))
    everything = rows.agg(F.count("*").alias("all"))
    totals = each.groupBy("role").agg(F.sum("n").alias("total"))
    roles = docs.join(totals, "role", "left").crossJoin(F.broadcast(vocabulary)).crossJoin(F.broadcast(everything))
    roles = roles.select("role", F.log(F.col("docs") / F.col("all")).alias("prior"), (-F.log(F.coalesce("total", F.lit(0)) + F.col("v"))).alias("floor"))
    return Model(roles, each.select("role", "term", F.log(F.col("n") + F.lit(1.0)).alias("gain")))


def predict(model: Model, rows: DataFrame, key: str, tokens: str) -> DataFrame:
    """key, role, score, margin. Only terms that a role has seen are joined; the floor covers the others."""
    terms = rows.select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count("*").alias("k"))
    sizes = terms.groupBy(key).agg(F.sum("k").alias("size"))
    gains = terms.join(model.terms, "term").groupBy(key, "role").agg(F.sum(F.col("k") * F.col("gain")).alias("gain"))
    scored = sizes.crossJoin(F.broadcast(model.roles)).join(gains, [key, "role"], "left")
    scored = scored.withColumn("score", F.coalesce("gain", F.lit(0.0)) + F.col("size") * F.col("floor") + F.col("prior"))
    w = Window.partitionBy(key).orderBy(F.desc(F.round("score", 6)), "role")
    return scored.withColumn("rank", F.row_number().over(w)).withColumn("margin", F.col("score") - F.lead("score").over(w)).filter("rank = 1").select(key, "role", "score", "margin")


def cross_validated(rows: DataFrame, key: str, role: str, tokens: str, fold: str) -> DataFrame:
    """key, fold, role, score, margin of every row by the model of the other folds: one count of everything, less the fold's own."""
    rows = rows.select(key, F.col(fold).alias("fold"), F.col(role).alias("own"), F.col(tokens).alias("ts"))
    # The counts of a text lie together, so that a task sums most of it itself.
    terms = written(rows.repartition(key).select(key, "fold", "own", F.explode("ts").alias("term")).groupBy(key, "fold", "own", "term").agg(F.count("*").alias("k")))
    held = written(terms.groupBy("fold", F.col("own").alias("role"), "term").agg(F.sum("k").alias("n_held"), F.count("*").alias("rows")))
    every = held.groupBy("role", "term").agg(F.sum("n_held").alias("n"))
    apart = held.groupBy("term").agg(F.count_distinct("fold").alias("folds"), F.min("fold").alias("fold"))
    only = apart.filter("folds = 1").groupBy("fold").agg(F.count("*").alias("n_only"))
    whole = apart.agg(F.count("*").alias("v"))
    docs = rows.groupBy("fold", F.col("own").alias("role")).agg(F.count("*").alias("d_held"))
    sums = held.groupBy("fold", "role").agg(F.sum("n_held").alias("t_held"))
    # folds x roles rows from here on
    grid = docs.select("fold").distinct().crossJoin(F.broadcast(docs.groupBy("role").agg(F.sum("d_held").alias("d")).join(sums.groupBy("role").agg(F.sum("t_held").alias("t")), "role")))
    zero = ["d_held", "t_held", "n_only"]
    grid = grid.join(docs, ["fold", "role"], "left").join(sums, ["fold", "role"], "left").join(only, "fold", "left").fillna(0, zero).crossJoin(F.broadcast(whole))
    grid = grid.select("fold", "role", (F.col("d") - F.col("d_held")).alias("docs"), F.log(F.col("t") - F.col("t_held") + F.col("v") - F.col("n_only")).alias("floor")).filter("docs > 0")
    grid = grid.withColumn("prior", F.log(F.col("docs") / F.sum("docs").over(Window.partitionBy("fold"))))
    rest = every.crossJoin(F.broadcast(held.select("fold").distinct())).join(held.select("fold", "role", "term", "n_held"), ["fold", "role", "term"], "left").withColumn("left_n", F.col("n") - F.coalesce("n_held", F.lit(0)))
    gain = written(rest.filter("left_n > 0").select("fold", "role", "term", F.log(F.col("left_n") + F.lit(1.0)).alias("gain")))
    hot = tables.often(held.groupBy("term").agg(F.sum("rows").alias("rows")), "term", "rows")
    seen = tables.join_often(terms.select(key, "fold", "term", "k"), gain, ["fold", "term"], hot, "term")
    gains = seen.groupBy(key, "fold", "role").agg(F.sum(F.col("k") * F.col("gain")).alias("gain"))
    sizes = terms.groupBy(key, "fold").agg(F.sum("k").alias("size"))
    scored = sizes.join(F.broadcast(grid), "fold").join(gains, [key, "fold", "role"], "left")
    scored = scored.withColumn("score", F.coalesce("gain", F.lit(0.0)) - F.col("size") * F.col("floor") + F.col("prior"))
    w = Window.partitionBy(key).orderBy(F.desc(F.round("score", 6)), "role")
    return scored.withColumn("rank", F.row_number().over(w)).withColumn("margin", F.col("score") - F.lead("score").over(w)).filter("rank = 1").select(key, "fold", "role", "score", "margin")
