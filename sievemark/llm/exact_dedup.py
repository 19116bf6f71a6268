"""Exact duplicates by progressive refinement, in DataFrame expressions.

Texts are grouped by their length, the groups of two or more by a hash of a prefix, and what is still in groups of
two or more by the SHA-256 of the whole text; full content is hashed for the rows of surviving groups alone.

Which groups survive a step is told to the next scan by a bitmap with one bit for each hash of a group: it has SLOTS
rows of 64 bits at most, whatever the number of groups, so that it can always be broadcast and no text is shuffled.
Two groups that share a bit cost one needless hash and never a wrong result. Groups are pre-aggregated before each
shuffle. Of the final groups, those with one in HOT_GROUPS rows or more are HOT_GROUPS at most and are joined back
by broadcast; no key of the join of the others holds more than that share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

PREFIX_CHARS = 64
SLOTS, HOT_GROUPS = 1 << 18, 1 << 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(text: Column) -> Column:
    """The text with A-Z in lower case and nothing else changed."""
    # Where every code point is one byte, lower() changes A-Z alone, and is much faster.
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def _prefix(text: Column) -> Column:
    return F.xxhash64(folded(F.substring(text, 1, PREFIX_CHARS)))


def _slot(value: Column) -> Column:
    return F.pmod(value, F.lit(SLOTS))


def _bit(value: Column) -> Column:
    """One of 64 bits by the part of a hash that _slot() leaves."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.floor(value / SLOTS), F.lit(64)).cast("int"))


def _bitmap(groups: DataFrame, name: str) -> DataFrame:
    """The groups (a column value: a 64-bit hash) of two rows or more (n), as at most SLOTS rows of 64 bits."""
    return materialize(groups.filter("n > 1").groupBy(_slot(F.col("value")).alias("slot")).agg(F.bit_or(_bit(F.col("value"))).alias(name)))


def _marked(rows: DataFrame, value: Column, bitmap: DataFrame, name: str) -> DataFrame:
    """rows with a column name: whether the bit of value is set."""
    found = rows.withColumn("slot", _slot(value)).join(F.broadcast(bitmap.withColumnRenamed(name, "bits")), "slot", "left")
    return found.withColumn(name, F.coalesce(F.col("bits").bitwiseAND(_bit(value)) != 0, F.lit(False))).drop("slot", "bits")


def exact_duplicates(docs: DataFrame, digests: bool = False) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, keep_id, group_size (long), kept, text_sha256.

    Texts are equal when they are after lower-casing A-Z alone; null is like an empty text. Of equal texts the row of
    the largest doc_id stays (keep_id, kept: doc_id = keep_id); a null doc_id counts in group_size and stays only
    where no row of the group has an id. Rows that repeat a doc_id and a text are one document: each counts, and they
    stay or go together. Rows of one doc_id with different texts are judged each. text_sha256 is the lower-case hex
    digest of the normalised text, null for rows that fell out before the last step, unless digests asks for all.
    Other columns are left out; no rows in, no rows out. Texts are taken whole.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    length = F.xxhash64(F.octet_length("text"))
    by_length = _bitmap(rows.groupBy(length.alias("value")).agg(F.count("*").alias("n")), "long_enough")
    rows = _marked(rows, length, by_length, "long_enough")
    value = F.xxhash64(F.octet_length("text"), _prefix(F.col("text")))
    by_prefix = _bitmap(rows.filter("long_enough").groupBy(value.alias("value")).agg(F.count("*").alias("n")), "begun_alike")
    rows = rows.withColumn("value", F.when(F.col("long_enough"), value))
    rows = _marked(rows, F.col("value"), by_prefix, "begun_alike")
    whole = F.sha2(folded(F.col("text")), 256)
    wanted = F.lit(True) if digests else F.col("begun_alike")
    judged = materialize(rows.select("doc_id", "begun_alike", F.when(wanted, whole).alias("text_sha256")))

    groups = materialize(judged.filter("begun_alike").groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1"))
    placed = _with_groups(judged.filter("begun_alike").drop("begun_alike"), groups)
    alone = judged.filter("NOT begun_alike").select("doc_id", "text_sha256", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    return placed.unionByName(alone).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def _with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows (doc_id, text_sha256) with keep_id and group_size of their groups; those of no group are alone."""
    least = F.lit(groups.agg(F.sum("group_size")).first()[0] or 0) / HOT_GROUPS
    hot = groups.filter(F.col("group_size") >= least).select("text_sha256", F.col("keep_id").alias("hot_keep"), F.col("group_size").alias("hot_size"))
    first = rows.join(F.broadcast(hot), "text_sha256", "left")
    found = first.filter("hot_size IS NOT NULL").select("doc_id", "text_sha256", F.col("hot_keep").alias("keep_id"), F.col("hot_size").alias("group_size"))
    others = first.filter("hot_size IS NULL").select("doc_id", "text_sha256").join(groups.filter(F.col("group_size") < least), "text_sha256", "left")
    single = F.col("group_size").isNull()
    rest = others.select("doc_id", "text_sha256", F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"))
    return found.unionByName(rest)
