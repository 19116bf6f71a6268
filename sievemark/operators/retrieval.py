"""Term weighting, vector fingerprints and exact reranking."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as St

from .tables import pick
from .written import written

#: Terms whose weight goes to the texts (the most frequent ones); rows and keys of questions that do at once; cells of scores that a task holds.
HOT_TERMS, ASKED_ROWS, ASKED_KEYS, CELLS = 200_000, 200_000, 1_024, 65_536
#: Texts that a task counts at once.
TEXT_ROWS = 512


def term_counts(df: DataFrame, key: str | list[str], tokens: Column) -> DataFrame:
    """key (or keys), term, tf (share of the key's tokens). The tokens are bound once, so that no row cuts its whole text again."""
    keys = [key] if isinstance(key, str) else key
    sized = F.flatten(F.transform(F.array(tokens), lambda ts: F.transform(ts, lambda term: F.struct(F.size(ts).alias("size"), term.alias("term")))))
    each = df.select(*keys, F.inline(sized))
    return each.groupBy(*keys, "term").agg((F.count("*") / F.max("size")).alias("tf"))


def bags(df: DataFrame, key: str, text: str, tokens) -> DataFrame:
    """key, terms, tf, written: term_counts() of tokens(text) with a row for each key. Texts are counted where they lie, but for rows that repeat a key."""
    key_type = df.schema[key].dataType.simpleString()
    repeated = written(df.groupBy(F.col(key).alias("again")).agg(F.count("*").alias("n")).filter("n > 1").withColumn("several", F.lit(True)).drop("n"))
    marked = df.select(F.col(key).alias("key"), F.col(text).alias("text")).join(repeated, F.col("key").eqNullSafe(F.col("again")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some in (b.slice(lo, TEXT_ROWS) for lo in range(0, len(b), TEXT_ROWS)):
                flat, sizes = some.column(1).flatten().dictionary_encode(), pc.list_value_length(some.column(1)).to_numpy(zero_copy_only=False)
                terms = max(1, len(flat.dictionary))
                pairs, times = np.unique(np.repeat(np.arange(len(some)), sizes) * terms + flat.indices.to_numpy(), return_counts=True)
                owner, term = np.divmod(pairs, terms)
                ends = pa.array(np.searchsorted(owner, np.arange(len(some) + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(ends, flat.dictionary.take(pa.array(term))), pa.ListArray.from_arrays(ends, pa.array(times / sizes[owner]))], ["key", "terms", "tf"])

    alone = marked.filter("several IS NULL").select("key", tokens(F.col("text")).alias("ts")).mapInArrow(run, f"key {key_type}, terms array<string>, tf array<double>")
    several = term_counts(marked.filter("several IS NOT NULL"), "key", tokens(F.col("text"))).groupBy("key").agg(F.collect_list(F.struct("term", "tf")).alias("c")).select("key", "c.term", "c.tf")
    return written(alone.union(several))


def _split(lists: pa.ListArray, values: pa.ListArray, known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, place in known (-1: not there) and value of each term."""
    place = pc.fill_null(pc.index_in(lists.flatten(), value_set=known), -1).to_numpy().astype(np.int64)
    return np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False)), place, values.flatten().to_numpy()


def bag_norms(bags: DataFrame, idf: DataFrame) -> DataFrame:
    """key, norm of bags() under idf (term, df, idf), written: HOT_TERMS terms bring their weight along, only rarer ones are looked up by a shuffle."""
    every = Window.orderBy(F.desc("df"))  # one row for each count that occurs
    least = idf.groupBy("df").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(every)).filter(F.col("upto") <= HOT_TERMS).agg(F.min("df")).first()[0]
    hot = idf.filter(F.col("df") >= least if least is not None else F.lit(False)).select("term", "idf").toArrow()  # HOT_TERMS rows at most
    known, weight = hot["term"].combine_chunks(), hot["idf"].to_numpy()
    key_type = bags.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, place, tf = _split(b.column(1), b.column(2), known)
            on, rare = place >= 0, np.flatnonzero(place < 0)
            ends = pa.array(np.searchsorted(owner[rare], np.arange(len(b) + 1)).astype(np.int32))
            squares = np.bincount(owner[on], (tf[on] * weight[place[on]]) ** 2, len(b))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(squares), pa.ListArray.from_arrays(ends, b.column(1).flatten().take(pa.array(rare))), pa.ListArray.from_arrays(ends, pa.array(tf[rare]))], ["key", "squares", "terms", "tf"])

    parted = written(bags.select("key", "terms", "tf").mapInArrow(run, f"key {key_type}, squares double, terms array<string>, tf array<double>"))
    rare = parted.select("key", F.inline(F.arrays_zip("terms", "tf")).alias("term", "tf")).hint("merge").join(idf.select("term", "idf"), "term")
    added = rare.groupBy("key").agg(F.sum((F.col("tf") * F.col("idf")) ** 2).alias("added"))
    return written(parted.select("key", "squares").join(added.hint("merge"), "key", "left").select("key", F.sqrt(F.col("squares") + F.coalesce("added", F.lit(0.0))).alias("norm")))


def best_bags(bags: DataFrame, norms: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query, key, score: at least the k bags of the highest weight for each query (ties at nine digits with them), of those that share a term with it.

    asked: query, term, weight (the query's, times what the term weighs in a bag), a table of any size: blocks of about ASKED_ROWS rows and ASKED_KEYS queries
    go to the bags one after the other. Of a bag only asked terms are shuffled, and of a task's scores only the best go on.
    """
    rows, queries = asked.agg(F.count("*"), F.count_distinct("query")).first()
    blocks = max(1, -(-rows // ASKED_ROWS), -(-queries // ASKED_KEYS))
    key_type, query_type = bags.schema["key"].dataType.simpleString(), asked.schema["query"].dataType.simpleString()

    def block(i: int) -> DataFrame:
        part = asked.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == i).select("query", "term", "weight").toArrow()  # about ASKED_ROWS rows
        term, query, weight = part["term"].combine_chunks().dictionary_encode(), part["query"].combine_chunks().dictionary_encode(), part["weight"].to_numpy()
        known, names = term.dictionary, query.dictionary
        order = np.argsort(term.indices.to_numpy(), kind="stable")
        first, of, weight = np.searchsorted(term.indices.to_numpy()[order], np.arange(len(known) + 1)), query.indices.to_numpy()[order].astype(np.int64), weight[order]

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                owner, place, tf = _split(b.column(1), b.column(2), known)
                on = place >= 0
                ends = pa.array(np.searchsorted(owner[on], np.arange(len(b) + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(place[on].astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(tf[on]))], ["key", "places", "tf"])

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            width, least = max(1, len(names)), np.full(max(1, len(names)), -np.inf)
            for b in batches:
                for some in (b.slice(lo, max(k, CELLS // width)) for lo in range(0, len(b), max(k, CELLS // width))):
                    place, sizes = some.column(1).flatten().to_numpy(), pc.list_value_length(some.column(1)).to_numpy(zero_copy_only=False)
                    n = first[place + 1] - first[place]
                    row = np.repeat(first[place] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    cell = np.repeat(np.repeat(np.arange(len(some)), sizes), n) * width + of[row]
                    found = np.bincount(cell, np.repeat(some.column(2).flatten().to_numpy(), n) * weight[row], len(some) * width).reshape(len(some), width) / some.column(3).to_numpy()[:, None]
                    if len(some) >= k:  # k of this task's rows reach the kth of any slice
                        least = np.maximum(least, np.partition(found, len(some) - k, axis=0)[len(some) - k])
                    at, q = np.nonzero((found > 0) & (found >= least - 2e-9))
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), some.column(0).take(pa.array(at)), pa.array(found[at, q])], ["query", "key", "score"])

        met = bags.select("key", "terms", "tf").mapInArrow(look_up, f"key {key_type}, places array<int>, tf array<double>").filter(F.size("places") > 0)
        return met.join(norms.select("key", "norm").hint("merge"), "key").select("key", "places", "tf", "norm").mapInArrow(score, f"query {query_type}, key {key_type}, score double")

    return reduce(DataFrame.unionByName, map(block, range(blocks)))


def smoothed_idf(n: Column, df: Column) -> Column:
    return F.log((1 + n) / (1 + df)) + 1


def tfidf(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """key, term, weight: unit-length sparse vectors. The corpus size is joined as one row, not collected."""
    counts = term_counts(df, key, tokens)
    n = df.agg(F.count("*").alias("n_docs"))
    found = counts.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n))
    raw = counts.join(found.select("term", smoothed_idf(F.col("n_docs"), F.col("df")).alias("idf")), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def sign_bits(vector: Column) -> Column:
    """Bits of the vector's signs (0 counts as set)."""
    return F.transform(vector, lambda x: (x >= 0).cast("int"))


def band_values(bits: Column, bands: int, width: int) -> Column:
    """struct(band, value) of each run of width bits."""
    value = lambda b: F.aggregate(F.slice(bits, b * width + 1, F.lit(width)), F.lit(0), lambda s, x: s * 2 + x)
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.struct(b.alias("band"), value(b).alias("value")))


#: Vectors that a task lays against the planes at once.
PLANE_ROWS = 512


@lru_cache(8)
def planes(n: int, dims: int) -> np.ndarray:
    """n planes of +1 and -1 [dimension, plane]: +1 where the MD5 of "plane|dimension" begins with 8 to f."""
    signs = [[1.0 if hashlib.md5(f"{p}|{d}".encode()).hexdigest()[0] >= "8" else -1.0 for p in range(n)] for d in range(dims)]
    return np.array(signs).reshape(dims, n)


def projected_words(vector: Column, words: int, width: int) -> Column:
    """words numbers of width bits each (64 at most): the sides of words * width planes, laid over all dimensions (0 counts as set). Null stays null."""

    def run(vectors: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(vectors), dtype=object)
        sizes = vectors.map(lambda v: -1 if v is None else len(v)).to_numpy()
        powers = np.uint64(1) << np.arange(width - 1, -1, -1, dtype=np.uint64)
        for dims in np.unique(sizes[sizes >= 0]):
            every = np.flatnonzero(sizes == dims)
            for at in (every[lo : lo + PLANE_ROWS] for lo in range(0, len(every), PLANE_ROWS)):
                bits = np.array([vectors.iloc[i] for i in at], float).reshape(len(at), dims) @ planes(words * width, int(dims)) >= 0
                values = (bits.reshape(len(at), words, width) * powers).sum(2, dtype=np.uint64).view(np.int64)
                for i, v in zip(at, values):
                    out.iat[i] = v
        return out

    return F.pandas_udf(run, St.ArrayType(St.LongType()))(vector)


def top_k(scored: DataFrame, key: str, score: str, tie: str, k: int) -> DataFrame:
    return pick(scored, key, F.desc(score), F.asc(tie), n=k)
