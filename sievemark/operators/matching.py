"""Soft matching of two small sets inside one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edit_likeness(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; two empty strings are alike."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def greedy_matches(gold: Column, pred: Column, threshold: float = 0.5) -> Column:
    """Pairs struct(score, g, p) (places from 0) taken greedily: highest score first, then lowest places, each item once."""
    own = lambda g, i: F.transform(pred, lambda p, j: F.struct((-F.round(edit_likeness(g, p), 9)).alias("minus"), i.alias("g"), j.alias("p")))
    pairs = F.array_sort(F.filter(F.flatten(F.transform(gold, own)), lambda x: -x["minus"] >= threshold))
    free = lambda done, x: ~F.exists(done, lambda y: (y["g"] == x["g"]) | (y["p"] == x["p"]))
    none = F.array().cast("array<struct<score: double, g: int, p: int>>")
    return F.aggregate(pairs, none, lambda done, x: F.when(free(done, x), F.concat(done, F.array(F.struct((-x["minus"]).alias("score"), x["g"].alias("g"), x["p"].alias("p"))))).otherwise(done))
