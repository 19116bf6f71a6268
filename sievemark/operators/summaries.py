"""Aggregates, ids, splits and set checks of evaluation tables."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, NumericType

from .tables import pick


def numeric_means(df: DataFrame, by: str) -> DataFrame:
    """Means of all numeric columns by one."""
    columns = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name != by]
    return df.groupBy(by).agg(*(F.avg(c).alias(c) for c in columns))


#: Rows that a group may have to be sorted as a whole.
SORTED_ROWS = 2_000_000


def nearest_ranks(df: DataFrame, by: str, value: str, shares: dict[str, float], parts: int = 100) -> DataFrame:
    """by and, under each name of shares, the value at the place round-half-even((n - 1) * share) of the sorted values (nulls left out).

    Where all rows are SORTED_ROWS at most, groups are sorted as they are. Beyond, with the same result, approximate bounds cut each group into parts; counts tell in which part a place lies, and only such parts are sorted, so
    that no task sees a whole group. The groups themselves are few (one row of bounds is broadcast for each).
    """
    known = df.filter(F.col(value).isNotNull()).select(F.struct(F.col(by).alias("k")).alias("g"), F.col(value).alias("v"))  # a struct: null groups join too
    at = lambda n, q: F.bround((n - 1) * F.lit(q), 0).cast("long")
    if known.count() <= SORTED_ROWS:
        own = Window.partitionBy("g")
        sorted_ = known.select("g", "v", (F.row_number().over(own.orderBy("v")) - 1).alias("place"), F.count("*").over(own).alias("n"))
        return sorted_.groupBy("g").agg(*(F.max(F.when(F.col("place") == at(F.col("n"), q), F.col("v"))).alias(k) for k, q in shares.items())).select(F.col("g.k").alias(by), *shares)
    bounds = known.groupBy("g").agg(F.percentile_approx("v", [i / parts for i in range(1, parts)], 20 * parts).alias("bounds"))
    placed = known.join(F.broadcast(bounds), "g").select("g", "v", F.size(F.filter("bounds", lambda b: b < F.col("v"))).alias("part"))
    counts = placed.groupBy("g", "part").agg(F.count("*").alias("n"))
    w = Window.partitionBy("g")
    before = counts.withColumn("before", F.sum("n").over(w.orderBy("part")) - F.col("n")).withColumn("all", F.sum("n").over(w))
    wanted = F.array(*(F.struct(F.lit(k).alias("share"), at(F.col("all"), q).alias("at")) for k, q in shares.items()))
    asked = before.select("g", "part", "before", "n", F.explode(wanted).alias("w")).filter((F.col("w.at") >= F.col("before")) & (F.col("w.at") < F.col("before") + F.col("n"))).select("g", "part", F.col("w.share").alias("share"), (F.col("w.at") - F.col("before") + 1).alias("place"))
    inside = placed.join(F.broadcast(asked.select("g", "part").distinct()), ["g", "part"])
    numbered = inside.withColumn("place", F.row_number().over(Window.partitionBy("g", "part").orderBy("v")).cast("long"))
    found = numbered.join(F.broadcast(asked), ["g", "part", "place"])
    return found.groupBy("g").agg(*(F.max(F.when(F.col("share") == k, F.col("v"))).alias(k) for k in shares)).select(F.col("g.k").alias(by), *shares)


def sequential_ids(df: DataFrame, block: Column, *order: Column, prefix: str = "", width: int = 6, name: str = "id") -> DataFrame:
    """df with gapless numbers from 1 in the given order, written after prefix with leading zeros.

    block ascends with the order and cuts it into stretches: rows are numbered inside a stretch, and the stretches' counts, of
    which there are few, are added up.
    """
    dealt = df.withColumn("id_block", block)
    counts = dealt.groupBy("id_block").agg(F.count("*").alias("id_rows"))
    begins = counts.withColumn("id_before", F.sum("id_rows").over(Window.orderBy("id_block")) - F.col("id_rows")).select("id_block", "id_before")
    numbered = dealt.withColumn("id_place", F.row_number().over(Window.partitionBy("id_block").orderBy(*order))).join(begins, "id_block")
    return numbered.withColumn(name, F.concat(F.lit(prefix), F.lpad((F.col("id_before") + F.col("id_place")).cast("string"), width, "0"))).drop("id_block", "id_place", "id_before")


def contract_breaks(df: DataFrame, by: str, expected: DataFrame) -> DataFrame:
    """Groups whose count isn't the expected one (by, expected), missing and unknown groups too."""
    counts = df.groupBy(by).agg(F.count("*").alias("found"))
    both = counts.join(expected, by, "full")
    return both.select(by, F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("expected", F.lit(0)).alias("expected")).filter("found <> expected")


def bench_metrics(rows: DataFrame, by: str | None = None) -> DataFrame:
    """Rates over rows (raw_correct, catchable, verdict, size_class, full_seconds, route_seconds): catch, false rejection, agreement, blind spots, and the time saved overall and on large ones."""
    wrong, ruled, large = ~F.col("raw_correct"), F.col("verdict") == "RULED_OUT_WRONG", F.col("size_class") == "large"
    rate = lambda part, whole: F.coalesce(F.try_divide(F.count_if(part & whole), F.count_if(whole)), F.lit(0.0))
    saved = lambda where: F.coalesce(F.try_divide(F.sum(F.when(where, F.col("full_seconds"))), F.sum(F.when(where, F.greatest("route_seconds", F.lit(1e-9))))), F.lit(0.0))
    return rows.groupBy(*([by] if by else [])).agg(
        F.coalesce(F.avg(F.col("raw_correct").cast("double")), F.lit(0.0)).alias("raw_accuracy"), rate(ruled, wrong & F.col("catchable")).alias("catch_rate"), rate(ruled, F.col("raw_correct")).alias("false_rejection_rate"),
        rate(F.col("catchable") == ruled, wrong).alias("agreement"), rate(ruled, wrong & ~F.col("catchable")).alias("blind_spot_rate"), saved(F.lit(True)).alias("compute_saved"), saved(large).alias("compute_saved_large"),
    )


def best_and_left(candidates: DataFrame, keys: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first candidate of each key; keys without one stay, with reviewed false."""
    best = pick(candidates, key, *order).withColumn("reviewed", F.lit(True))
    return keys.join(best, key, "left").fillna(False, ["reviewed"])


def enum_gaps(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Values on one side only: value, side (missing: only in a; extra: only in b)."""
    left, right = a.select(column).distinct(), b.select(column).distinct()
    return left.subtract(right).select(F.col(column).alias("value"), F.lit("missing").alias("side")).union(right.subtract(left).select(F.col(column), F.lit("extra")))


def contains_all(required: Column, used: Column) -> Column:
    return F.size(F.array_except(required, used)) == 0


def merged_pairs(parts: list[DataFrame]) -> DataFrame:
    """Candidate pairs (a, b, score, rank, sources) of several lists, each once: highest score, best rank, all sources."""
    whole = reduce(DataFrame.unionByName, parts)
    return whole.groupBy("a", "b").agg(F.max("score").alias("score"), F.min("rank").alias("rank"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"))


def eligible(source: DataFrame, used: list[DataFrame], key: str) -> DataFrame:
    """Rows of source whose key is in none of the used ones, in the order of a hash."""
    rest = reduce(lambda df, u: df.join(u.select(key), key, "left_anti"), used, source)
    return rest.withColumn("order_hash", F.md5(F.col(key).cast("string")))


def segments(text: Column, most: int, least: int = 40) -> Column:
    """A text in segments: parts between blank lines and before headings, short ones left out, long ones filled with whole sentences up to `most` signs."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n+|\n(?=#{1,6}\s)"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: F.length(p) >= least)
    begin = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    closed = lambda s: F.when(F.length(s["open"]) > least, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"])

    def fill(s: Column, x: Column) -> Column:
        fits = F.length(s["open"]) + F.length(x) < most
        joined = F.when(s["open"] == "", x).otherwise(F.concat(s["open"], F.lit(" "), x))
        return F.struct(F.when(fits, s["done"]).otherwise(closed(s)).alias("done"), F.when(fits, joined).otherwise(x).alias("open"))

    cut = lambda p: F.aggregate(F.split(p, r"(?<=[.!?])\s+"), begin, fill, closed)
    return F.flatten(F.transform(parts, lambda p: F.when(F.length(p) <= most, F.array(p)).otherwise(cut(p))))


@F.pandas_udf(DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Likeness of two strings by their longest matching blocks (Ratcliff and Obershelp); Spark has edit distances only, which differ."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


def index_bytes(n: Column | int, dims: int, bits: int, bands: int = 0, subspaces: int = 0, centroids: int = 0) -> dict[str, Column]:
    """Bytes of indexes over n vectors: raw floats, packed sign bits, band tables and product codes with their codebooks."""
    n = F.lit(n) if isinstance(n, int) else n
    return {"raw": n * (dims * 4), "bits": n * ((bits + 7) // 8), "bands": n * (bands * 8), "codes": n * subspaces + F.lit(centroids * dims * 4)}


def spans(text: Column, most: int = 8) -> Column:
    """Quoted spans and runs of capitalised words, each once, in that order; where they are fewer than two, the most frequent long words (ties: first seen) instead; `most` at most."""
    text = F.coalesce(text, F.lit(""))
    quoted = F.regexp_extract_all(text, F.lit('"([^"\n]{2,60})"'), F.lit(1))
    proper = F.regexp_extract_all(text, F.lit("([A-Z][a-z]+(?: [A-Z][a-z]+)+)"), F.lit(1))
    usable = F.array_distinct(F.concat(quoted, proper))
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z]{6,})"), F.lit(1))
    ranked = F.array_sort(F.transform(F.array_distinct(words), lambda w, i: F.struct((-F.size(F.filter(words, lambda x: x == w))).alias("n"), i.alias("i"), w.alias("w"))))
    return F.slice(F.when(F.size(usable) >= 2, usable).otherwise(F.transform(ranked, lambda r: r["w"])), 1, most)
