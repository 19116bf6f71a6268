"""How far the sources of a language diverge in their terms: sketch-prefiltered counting and sparse pair joins.

First, each task counts documents per language and term in a count-min sketch of SKETCH_ROWS rows of 2^SKETCH_BITS
counters; the sketches are added up cell by cell and stop at the least document frequency asked for, so that a cell
is a byte and the merged sketch has a fixed size. An estimate is never too small: a term whose estimate is under
that frequency can't have it, and is discarded before anything is shuffled. What survives is counted exactly.

A group gives every kept term a weight, those that it lacks too. Pairs of groups are compared term by term only where
both hold the term; terms that one of them holds alone depend on the other's weight of absent terms, and are summed
over the histogram of the group's counts; terms that both lack are one product.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ragged
from .common import BROADCAST_ROWS, materialize

#: What each byte of a text counts as: letters and bytes beyond ASCII as themselves, A-Z in lower case, all others as spaces between terms.
_AS_TERMS = np.full(256, 32, np.uint8)
_AS_TERMS[97:123], _AS_TERMS[128:] = np.arange(97, 123), np.arange(128, 256)
_AS_TERMS[65:91] = np.arange(97, 123)
SCALE = 1_000_000_000
SKETCH_ROWS, SKETCH_BITS, BLOCK_BITS = 3, 20, 16
#: Bytes of text that are tokenised at once; rows that a task pre-aggregates before it passes them on.
SLICE_BYTES, KEPT_ROWS = 1 << 20, 400_000
BATCH_ROWS = 50_000
#: A term in more sources is joined in parts, each with so many of the sources on one side.
PART_SOURCES = 1_024
TOP_TERMS = 200


def _terms(langs: pa.Array, sources: pa.Array, texts: pa.Array) -> Iterator[pa.Table]:
    """lang, source, term, n (occurrences) and docs (documents) of each stretch of texts."""
    for lo, hi, data, offsets in ragged.slices(texts, SLICE_BYTES):
        plain = pa.StringArray.from_buffers(hi - lo, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(_AS_TERMS[data]))
        lists = pc.split_pattern(plain, " ")
        words, row = pc.list_flatten(lists), pc.list_parent_indices(lists)
        coded = pc.dictionary_encode(words)
        code, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        pairs, times = np.unique(row.to_numpy().astype(np.int64) * max(1, len(names)) + code, return_counts=True)
        row, code = np.divmod(pairs, max(1, len(names)))
        real = np.asarray(pc.not_equal(names, ""))[code] if len(code) else np.zeros(0, bool)
        row, code, times = row[real], code[real], times[real]
        if len(row):
            yield pa.table({"lang": langs.slice(lo, hi - lo).take(pa.array(row)), "source": sources.slice(lo, hi - lo).take(pa.array(row)), "term": names.take(pa.array(code)), "n": pa.array(times), "docs": pa.array(np.ones(len(row), np.int64))})


def _added(tables: list[pa.Table], keys: list[str]) -> pa.Table:
    found = pa.concat_tables(tables).group_by(keys, use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return found.rename_columns([c.removesuffix("_sum") for c in found.column_names]).select([*keys, "n", "docs"])


def _hashes(langs: pa.Array, terms: pa.Array) -> np.ndarray:
    """A 64-bit hash of each language and term."""
    out = np.zeros(len(terms), np.uint64)
    for salt, column in ((1, langs), (0, terms)):
        coded = pc.dictionary_encode(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)
        data, offsets = next(((d, o) for _, _, d, o in ragged.slices(coded.dictionary, 1 << 40)), (np.zeros(0, np.uint8), np.zeros(1, np.int64)))
        values = ragged.hashes(data, offsets[:-1], offsets[1:]) + np.uint64(salt)
        out = ragged.mix(out) + values[coded.indices.to_numpy(zero_copy_only=False)] if len(values) else out
    return ragged.mix(out)


def _cells(hashes: np.ndarray) -> list[np.ndarray]:
    """The places of each hash in the rows of a sketch that is laid out row after row."""
    mask = np.uint64((1 << SKETCH_BITS) - 1)
    return [((hashes >> np.uint64(SKETCH_BITS * r)) & mask).astype(np.int64) + (r << SKETCH_BITS) for r in range(SKETCH_ROWS)]


def estimates(sketch: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return np.minimum.reduce([sketch[c] for c in _cells(hashes)])


def _filled(sketch: np.ndarray, hashes: np.ndarray, docs: np.ndarray, most: int) -> None:
    """Add documents to a sketch whose cells stop at most."""
    for cells in _cells(hashes):
        places, at = np.unique(cells, return_inverse=True)
        sketch[places] = np.minimum(sketch[places] + np.bincount(at, weights=docs).astype(np.int64), most)


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def frequency_sketch(docs: DataFrame, min_docs: int = 3) -> np.ndarray:
    """The merged sketch of documents per language and term of docs (lang, source, text, without nulls); its size is fixed by SKETCH_BITS."""
    n_cells = SKETCH_ROWS << SKETCH_BITS
    most = min(min_docs, 255)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, used = np.zeros(n_cells, np.uint8), False
        for b in batches:
            for table in _terms(b.column(0), b.column(1), ragged.texts_of(b.column(2))):
                found = _added([table], ["lang", "term"])
                _filled(sketch, _hashes(found["lang"], found["term"]), found["docs"].to_numpy(), most)
                used = True
        if used:
            yield from _blocks({i: sketch[i << BLOCK_BITS : (i + 1) << BLOCK_BITS] for i in range(n_cells >> BLOCK_BITS)})

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            for block, raw in zip(b.column(0).to_pylist(), b.column(1)):
                cells = np.frombuffer(raw.as_buffer(), np.uint8)
                found[block] = np.minimum(found[block].astype(np.int64) + cells, most).astype(np.uint8) if block in found else cells.copy()
        yield from _blocks(found)

    blocks = docs.mapInArrow(local, "block int, cells binary")
    # Two rounds, so that no task reads the blocks of all tasks.
    for keys in ((F.col("block"), F.pmod(F.spark_partition_id(), F.lit(16))), (F.col("block"),)):
        blocks = blocks.repartition(*keys).mapInArrow(merged, "block int, cells binary")
    sketch = np.zeros(n_cells, np.uint8)
    for block, raw in blocks.collect():  # n_cells bytes in all
        sketch[block << BLOCK_BITS : (block + 1) << BLOCK_BITS] = np.frombuffer(raw, np.uint8)
    return sketch


def _blocks(found: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([c.tobytes() for c in found.values()], pa.binary())], ["block", "cells"])


def term_counts(docs: DataFrame, min_docs: int = 3) -> DataFrame:
    """lang, source, term, n, docs: exact counts of the terms whose language may have them in min_docs documents, written."""
    sketch = frequency_sketch(docs, min_docs)
    keys, least = ["lang", "source", "term"], min(min_docs, 255)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []
        for b in batches:
            for table in _terms(b.column(0), b.column(1), ragged.texts_of(b.column(2))):
                found = _added([table], keys)
                waiting.append(found.filter(pa.array(estimates(sketch, _hashes(found["lang"], found["term"])) >= least)))
                if sum(map(len, waiting)) > KEPT_ROWS:
                    waiting = [_added(waiting, keys)]
                    if len(waiting[0]) > KEPT_ROWS // 2:
                        yield from waiting.pop().combine_chunks().to_batches(max_chunksize=BATCH_ROWS)
                    ragged.release()
        if waiting:
            yield from _added(waiting, keys).combine_chunks().to_batches(max_chunksize=BATCH_ROWS)

    counted = docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return materialize(counted.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def _weight(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (n + 1) / (total + terms)), exact whatever the counts."""
    wide = lambda c: c.cast("decimal(19,0)")
    return 1 + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(n + 1), wide(total + terms))


def _far(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q): weights are at most SCALE + 1, so that a long holds the square."""
    return F.call_function("div", (p - q) * (p - q), q)


def _beside(rows: DataFrame, groups: DataFrame, keys: list[str], small: bool) -> DataFrame:
    return rows.join(F.broadcast(groups) if small else groups, keys)


def divergence(docs: DataFrame, min_docs: int = 3, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value (long), rank (int) of docs (lang, source, text).

    Terms are runs of letters A-Z (lower-cased), a-z and signs beyond ASCII; a language keeps those in min_docs of its
    documents or more. A group (lang, source) and the language give each kept term the weight
    1 + floor(10^9 (count + 1) / (all counts + kept terms)), and p is floor((p - q)^2 / q) away from q. Part pair: each
    other source of the language, value summed over all kept terms (0 if there is none), all ranks. Part term: the kept
    terms that the group has more than its language (p > q), value against the language, top_terms ranks. Ranks go by
    value descending, then by item. Null lang, source and text are like empty ones, and groups of their own; repeated
    rows are documents each. A group without terms has pairs alone; a language of one source has none. Other columns
    are left out; no rows in, no rows out. Texts are taken whole.
    """
    docs = _columns(docs)
    exact = term_counts(docs, min_docs)
    # A term's rows are its sources: one shuffle gives what the language has of it, beside each.
    term = Window.partitionBy("lang", "term")
    counted = exact.select("lang", "source", "term", "n", F.sum("n").over(term).alias("lang_n"), F.sum("docs").over(term).alias("in_docs"), F.count("*").over(term).alias("holders"), (F.row_number().over(term.orderBy("source")) == 1).alias("first"))
    held = materialize(counted.filter(F.col("in_docs") >= min_docs).drop("in_docs"))

    langs = held.filter("first").groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "terms", "lang_total"])
    groups = materialize(groups.withColumn("none", F.when(F.col("terms") > 0, _weight(F.lit(0).cast("long"), F.col("total"), F.col("terms")))))
    small = groups.count() <= BROADCAST_ROWS

    weighed = _beside(held, groups, ["lang", "source"], small)
    weighed = weighed.select("lang", "source", "term", "n", "holders", "none", _weight(F.col("n"), F.col("total"), F.col("terms")).alias("p"), _weight(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"))
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = weighed.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _far(F.col("p"), F.col("q")).alias("value"))
    over = over.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= top_terms)
    apart = _pairs(groups, weighed, small).select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value").withColumn("rank", F.row_number().over(first))
    return apart.unionByName(over)


def _pairs(groups: DataFrame, weighed: DataFrame, small: bool) -> DataFrame:
    """lang, source, other, value: every group against each other one of its language."""
    shapes = materialize(weighed.groupBy("lang", "source", "none", "p").agg(F.count("*").alias("times")))
    mine = groups.select("lang", "source", "none", "terms")
    other = groups.select("lang", F.col("source").alias("other"), F.col("none").alias("other_none"))
    differ = lambda df: df.filter("source <> other")
    lacked = _far(F.col("none"), F.col("other_none"))
    base = differ(_by_lang(mine, other, small)).select("lang", "source", "other", F.when(F.col("terms") > 0, F.col("terms") * lacked).otherwise(0).alias("value"))
    left = differ(_by_lang(shapes, other, small)).select("lang", "source", "other", (F.col("times") * (_far(F.col("p"), F.col("other_none")) - lacked)).alias("value"))
    turned = shapes.select("lang", F.col("source").alias("other"), F.col("none").alias("other_none"), "p", "times")
    right = differ(_by_lang(turned, groups.select("lang", "source", "none"), small)).select("lang", "source", "other", (F.col("times") * (_far(F.col("none"), F.col("p")) - lacked)).alias("value"))

    parts = F.ceil(F.col("holders") / PART_SOURCES).cast("int")
    one = weighed.select("lang", "term", "source", "none", "p", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    two = weighed.select("lang", "term", F.col("source").alias("other"), F.col("none").alias("other_none"), F.col("p").alias("other_p"), F.pmod(F.hash("source"), parts).alias("part"))
    p, p0, q, q0 = (F.col(c) for c in ("p", "none", "other_p", "other_none"))
    common = differ(one.join(two, ["lang", "term", "part"])).select("lang", "source", "other", (_far(p, q) - _far(p, q0) - _far(p0, q) + _far(p0, q0)).alias("value"))
    summed: Callable[[DataFrame], DataFrame] = lambda df: df.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    return summed(base.unionByName(summed(left)).unionByName(summed(right)).unionByName(summed(common)))


def _by_lang(rows: DataFrame, groups: DataFrame, small: bool, salts: int = 64) -> DataFrame:
    """rows beside every group of their language: by broadcast while the groups are few, else in salted parts of a language."""
    if small:
        return rows.join(F.broadcast(groups), "lang")
    spread = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("salt", F.pmod(F.hash(*rows.columns), F.lit(salts))).join(spread, ["lang", "salt"]).drop("salt")
