"""Join guards, keyed look-ups, ranking, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Blank or repeated keys with their counts."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == ""))


def unique(df: DataFrame, key: str) -> DataFrame:
    """df; raises if a key is blank or repeated."""
    bad = [r[0] for r in duplicates(df, key).limit(5).collect()]
    if bad:
        raise ValueError(f"{key} is blank or repeated: {bad}")
    return df


def join_required(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join in which every left key must be found."""
    bad = [r[0] for r in left.join(right, key, "left_anti").select(key).limit(5).collect()]
    if bad:
        raise KeyError(f"{key} not found: {bad}")
    return left.join(right, key)


def left_with_marker(left: DataFrame, right: DataFrame, key: str, marker: str = "found") -> DataFrame:
    """Left join with YES or NO in marker."""
    return left.join(right.withColumn(marker, F.lit("YES")), key, "left").fillna("NO", [marker])


def reconcile(expected: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """Distinct keys of both sides with status matched, missing or unknown."""
    a = expected.select(key).distinct().withColumn("e", F.lit(True))
    b = given.select(key).distinct().withColumn("g", F.lit(True))
    status = F.when(F.col("e").isNull(), "unknown").when(F.col("g").isNull(), "missing").otherwise("matched")
    return a.join(b, key, "full").select(key, status.alias("status"))


def pick(df: DataFrame, key: str | list[str], *order: Column, n: int = 1) -> DataFrame:
    """The first n rows of each key in the given order."""
    w = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order)
    return df.withColumn("pick_rank", F.row_number().over(w)).filter(F.col("pick_rank") <= n).drop("pick_rank")


def ranked(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order)).cast("long"))


def top(df: DataFrame, key: list[str], *order: Column, n: int) -> DataFrame:
    """The first n rows of each key with their rank: tasks cut to n before a key's rows meet."""
    return ranked(pick(df, key, *order, n=n), key, *order)


def placed(df: DataFrame, group: str, block: Column, *order: Column) -> DataFrame:
    """df with place (from 0, in the given order inside each group) and whole (the group's rows).

    block ascends with the order and cuts groups into stretches: rows are numbered inside a stretch, and the stretches' counts
    are added up, so that a group that holds a third of all rows is many tasks.
    """
    dealt = df.withColumn("place_group", F.struct(F.col(group).alias("key"))).withColumn("place_block", block)  # a struct: null groups join too
    counts = dealt.groupBy("place_group", "place_block").agg(F.count("*").alias("n"))
    w = Window.partitionBy("place_group")
    begins = counts.select("place_group", "place_block", (F.sum("n").over(w.orderBy("place_block")) - F.col("n")).alias("before"), F.sum("n").over(w).alias("whole"))
    inside = F.row_number().over(Window.partitionBy("place_group", "place_block").orderBy(*order)) - 1
    return dealt.withColumn("inside", inside).join(begins, ["place_group", "place_block"]).withColumn("place", F.col("before") + F.col("inside")).drop("place_group", "place_block", "before", "inside")


def split_by_position(df: DataFrame, group: str, block: Column, *order: Column, shares: tuple[int, int] = (70, 85)) -> DataFrame:
    """train, dev and test by the place in each group (upper bounds in percent)."""
    place = F.col("place") * 100
    split = F.when(place < F.col("whole") * shares[0], "train").when(place < F.col("whole") * shares[1], "dev").otherwise("test")
    return placed(df, group, block, *order).withColumn("split", split).drop("place", "whole")


def with_fallback(candidates: DataFrame, key: str, strict: str) -> DataFrame:
    """The strict rows of each key; all its rows where none is strict."""
    return candidates.withColumn("any_strict", F.max(F.col(strict).cast("int")).over(Window.partitionBy(key))).filter(F.col(strict) | (F.col("any_strict") == 0)).drop("any_strict")


#: Keys with one in so many of all rows are joined by broadcast: they are at most as many.
HOT_KEYS = 4_096


def often(counted: DataFrame, key: str, rows: str, keys: int = HOT_KEYS) -> DataFrame:
    """The keys, of a table with one row and a count (rows) for each, that hold one in keys of all rows or more."""
    total = counted.agg(F.sum(rows).alias("hot_total"))  # one row
    return counted.crossJoin(F.broadcast(total)).filter(F.col(rows) * keys >= F.col("hot_total")).select(key)


def join_often(rows: DataFrame, table: DataFrame, on: str | list[str], hot: DataFrame, key: str) -> DataFrame:
    """rows joined with table: what has a hot key (a table of few keys) meets it by broadcast where it lies, only the rest is shuffled. rows is read twice and should be written."""
    hot = F.broadcast(hot)
    return rows.join(F.broadcast(table.join(hot, key, "left_semi")), on).unionByName(rows.join(hot, key, "left_anti").join(table, on))
