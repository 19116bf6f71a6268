"""A product quantiser and inverted lists over vectors, trained and searched in the cluster.

Coordinates are fixed-point numbers (SCALE to one), so that sums, means and distances are exact whatever the order in
which tasks add up, and a codebook is the same on every cluster. Training is Lloyd's: every round is one pass in which
tasks assign their vectors and add up members, and only the sums of the cells (parts x codes) reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .retrieval import cosine
from .tables import pick

SCALE = 65_536
ROUNDS = 8
#: Vectors that a task holds against the codes at once, and vectors of a block of a search.
SLICE_ROWS, BLOCK_ROWS = 2_048, 4_096
#: Tasks among which a search deals its blocks, and queries whose scores a task holds at once.
SPREAD, QUERY_ROWS = 64, 256


def fixed(vectors: pa.Array) -> np.ndarray:
    """Vectors [row, dimension] as whole numbers of 1/SCALE. All must have one length."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    values = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.floor(values.reshape(len(vectors), -1) * SCALE + 0.5).astype(np.int64)


def _distances(blocks: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Squared distances [row, part, code] of blocks [row, part, width] to books [part, code, width]."""
    return ((blocks[:, :, None, :] - books[None]) ** 2).sum(3)


def encode(vectors: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The nearest code of each part [row, part]; of equally near ones the first."""
    parts, _, width = books.shape
    found = [_distances(vectors[i : i + SLICE_ROWS].reshape(-1, parts, width), books).argmin(2) for i in range(0, len(vectors), SLICE_ROWS)]
    return np.concatenate(found) if found else np.zeros((0, parts), np.int64)


def _present(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector")).filter("key IS NOT NULL AND vector IS NOT NULL AND NOT exists(vector, x -> x IS NULL)")


def seeds(df: DataFrame, key: str, vector: str, n: int) -> np.ndarray:
    """The n vectors whose keys have the least MD5 digests: a choice that neither order nor partitions change."""
    # n rows at most reach the driver.
    first = _present(df, key, vector).orderBy(F.md5(F.col("key").cast("string")), "key").limit(n).select("vector").collect()
    return np.floor(np.array([r[0] for r in first], float).reshape(len(first), len(first[0][0]) if first else 0) * SCALE + 0.5).astype(np.int64)


def train(df: DataFrame, key: str, vector: str, parts: int, codes: int, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks [part, code, width] of the vectors, whose length parts must divide: k-means of each part alone.

    Rows with a null key, vector or coordinate are left out. With fewer vectors than codes there are as many codes as
    vectors. A code without members keeps its place. No vectors: no codes.
    """
    begin = seeds(df, key, vector, codes)
    if not len(begin):
        return np.zeros((parts, 0, 0), np.int64)
    if begin.shape[1] % parts:
        raise ValueError("the number of parts must divide the vectors' length")
    books = begin.reshape(len(begin), parts, -1).transpose(1, 0, 2).copy()
    held = _present(df, key, vector).select("vector")
    for _ in range(rounds):
        now = _round(held, books)
        if np.array_equal(now, books):
            break
        books = now
    return books


def _round(held: DataFrame, books: np.ndarray) -> np.ndarray:
    parts, codes, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, sizes = np.zeros((parts, codes, width), np.int64), np.zeros((parts, codes), np.int64)
        for b in batches:
            vectors = fixed(b.column(0)) if len(b) else np.zeros((0, parts * width), np.int64)
            near, blocks = encode(vectors, books), vectors.reshape(-1, parts, width)
            for p in range(parts):
                np.add.at(sums[p], near[:, p], blocks[:, p])
                sizes[p] += np.bincount(near[:, p], minlength=codes)
        p, c = np.nonzero(sizes)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(c), pa.array(sizes[p, c]), pa.array(list(sums[p, c]), pa.list_(pa.int64()))], ["part", "code", "n", "sums"])

    cells = held.mapInArrow(run, "part long, code long, n long, sums array<long>")
    added = cells.select("part", "code", "n", F.posexplode("sums").alias("at", "x")).groupBy("part", "code", "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    out = books.copy()
    for part, code, at, x, n in added.collect():  # parts x codes x width numbers at most
        out[part, code, at] = np.floor(x / n)
    return out


def coded(df: DataFrame, key: str, vector: str, books: np.ndarray) -> DataFrame:
    """key and codes (a byte for each part) of every vector."""
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                near = encode(fixed(b.column(1)), books).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([row.tobytes() for row in near], pa.binary())], ["key", "codes"])

    return _present(df, key, vector).mapInArrow(run, f"key {key_type}, codes binary").withColumnRenamed("key", key)


def listed(codes: Column) -> Column:
    """A binary of codes as numbers joined by spaces."""
    return F.array_join(F.transform(F.split(F.regexp_replace(F.hex(codes), "(..)(?=.)", "$1 "), " "), lambda x: F.conv(x, 16, 10)), " ")


def _blocks(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Rows gathered to lists of BLOCK_ROWS at most, inside their partitions; group says which lists may meet."""
    types = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            groups = b.column("group").to_numpy()
            order = np.argsort(groups, kind="stable")
            cuts = [*np.flatnonzero(np.diff(groups[order], prepend=-1)).tolist(), len(order)]
            for a, z in zip(cuts, cuts[1:]):
                for lo in range(a, z, BLOCK_ROWS):
                    part = b.take(pa.array(order[lo : min(z, lo + BLOCK_ROWS)]))
                    lists = [pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column(f)) for f in fields]
                    yield pa.RecordBatch.from_arrays([part.column("group").slice(0, 1), *lists], ["group", *fields])

    return rows.select("group", *fields).mapInArrow(run, "group long, " + ", ".join(f"{f} array<{types[f]}>" for f in fields))


def met_blocks(held: DataFrame, held_fields: list[str], asked: DataFrame, asked_fields: list[str], spread: int = SPREAD) -> DataFrame:
    """Blocks of held rows beside blocks of asked ones of their group: the held blocks are dealt into spread tasks a group, to each of which the asked ones, few beside them, are copied."""
    buckets = F.pmod(F.xxhash64(F.get(held_fields[0], F.lit(0))), F.lit(spread))
    left = _blocks(held, held_fields).withColumn("bucket", buckets)
    right = _blocks(asked, asked_fields).withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long"))))
    return left.hint("merge").join(right, ["group", "bucket"]).drop("group", "bucket")


def nearest(held: DataFrame, asked: DataFrame, k: int, bands: bool = False) -> DataFrame:
    """query, key, score: the k rows of the highest cosine to each query (ties at nine digits go to the smaller key), never the query itself.

    held: key, vector; asked: query, vector; with bands each has bands too (numbers under 256), and only rows that have
    one in common with the query count. Blocks meet blocks, so that a task holds two of them whatever the tables' sizes;
    of each pair of blocks k rows a query go on. Null vectors are left out; all have one length.
    """
    fields = ["vector", "bands"] if bands else ["vector"]
    everywhere = lambda df: df.filter("vector IS NOT NULL").withColumn("group", F.lit(0).cast("long"))
    as_bytes = lambda df: df.withColumn("bands", F.transform("bands", lambda x: x.cast("smallint"))) if bands else df
    renamed = lambda df: as_bytes(everywhere(df)).withColumnsRenamed({f: f"asked_{f}" for f in fields})
    key_type, query_type = held.schema["key"].dataType.simpleString(), asked.schema["query"].dataType.simpleString()
    met = met_blocks(as_bytes(everywhere(held)), ["key", *fields], renamed(asked), ["query", *(f"asked_{f}" for f in fields)])

    def unit(lists: pa.Array) -> np.ndarray:
        v = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(lists), -1)
        return v / np.sqrt((v * v).sum(1, keepdims=True))

    def small(lists: pa.Array) -> np.ndarray:
        return lists.flatten().to_numpy(zero_copy_only=False).astype(np.uint8).reshape(len(lists), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                of = lambda c: b.column(c)[i].values  # noqa: B023, E731
                keys, queries = of("key"), of("query")
                ids, wanted, found = keys.to_numpy(), queries.to_numpy(), []
                rows = unit(of("vector"))
                if bands:
                    codes, own = small(of("bands")), small(of("asked_bands"))
                for lo in range(0, len(wanted), QUERY_ROWS):
                    scores = unit(of("asked_vector").slice(lo, QUERY_ROWS)) @ rows.T
                    for q, far in enumerate(scores, lo):
                        other = ids != wanted[q]
                        if bands:
                            other &= (codes == own[q]).any(1)
                        other = np.flatnonzero(other)
                        if len(other) > k:
                            least = np.partition(far[other], -k)[-k]
                            other = other[far[other] >= least - 2e-9]
                        best = other[np.lexsort((ids[other], -np.round(far[other], 9)))[:k]]
                        found.append((np.full(len(best), q), best, far[best]))
                if found:
                    at, best, far = (np.concatenate(x) for x in zip(*found))
                    yield pa.RecordBatch.from_arrays([queries.take(pa.array(at)), keys.take(pa.array(best)), pa.array(far)], ["query", "key", "score"])

    found = met.mapInArrow(run, f"query {query_type}, key {key_type}, score double")
    return pick(found, "query", F.desc(F.round("score", 9)), F.asc("key"), n=k)


def within(held: DataFrame, asked: DataFrame, most: int) -> DataFrame:
    """query, key, distance: the rows of held (key, code) whose codes, arrays of 64-bit numbers, differ from a query's (query, code) in most bits at most, never the query itself.

    Blocks meet blocks, so that a task holds two of them whatever the tables' sizes; all pairs are compared. Null keys and codes are left out.
    """
    filled = lambda df, c: df.filter(F.col(c).isNotNull() & F.col("code").isNotNull()).withColumn("group", F.lit(0).cast("long"))
    key_type, query_type = held.schema["key"].dataType.simpleString(), asked.schema["query"].dataType.simpleString()
    met = met_blocks(filled(held, "key"), ["key", "code"], filled(asked, "query").withColumnRenamed("code", "asked_code"), ["query", "asked_code"])

    def words(lists: pa.Array) -> np.ndarray:
        return lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(lists), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                keys, queries = b.column("key")[i].values, b.column("query")[i].values
                codes, own, ids, wanted = words(b.column("code")[i].values), words(b.column("asked_code")[i].values), keys.to_numpy(zero_copy_only=False), queries.to_numpy(zero_copy_only=False)
                for lo in range(0, len(wanted), QUERY_ROWS):
                    far = np.zeros((len(own[lo : lo + QUERY_ROWS]), len(ids)), np.int64)
                    for w in range(codes.shape[1]):
                        far += np.bitwise_count(own[lo : lo + QUERY_ROWS, w, None] ^ codes[:, w])
                    q, k = np.nonzero((far <= most) & (wanted[lo : lo + QUERY_ROWS, None] != ids))
                    yield pa.RecordBatch.from_arrays([queries.take(pa.array(q + lo)), keys.take(pa.array(k)), pa.array(far[q, k])], ["query", "key", "distance"])

    return met.mapInArrow(run, f"query {query_type}, key {key_type}, distance long")


def shortlists(codes: DataFrame, asked: DataFrame, key: str, books: np.ndarray, limit: int, spread: int = SPREAD) -> DataFrame:
    """query, key, distance: the limit nearest keys of each query by its distance tables; ties go to the smaller key.

    codes: group, key, codes; asked: group, query, vector. Blocks of queries meet blocks of codes of their group: a
    group's pairs are compared in numpy, and of each pair of blocks only limit rows a query go on. A row whose codes
    are all those of the query counts half its distance. Distances are in fixed-point units, doubled.
    """
    parts, _, width = books.shape
    key_type, query_type = (df.schema[c].dataType.simpleString() for df, c in ((codes, key), (asked, "query")))
    met = met_blocks(codes.withColumnRenamed(key, "key"), ["key", "codes"], asked, ["query", "vector"], spread)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                keys, raw, queries, vectors = (b.column(c)[i].values for c in ("key", "codes", "query", "vector"))
                held = np.frombuffer(b"".join(raw.to_pylist()), np.uint8).reshape(-1, parts)
                wanted = fixed(vectors)
                tables = _distances(wanted.reshape(-1, parts, width), books).reshape(len(wanted), -1)
                own = encode(wanted, books)
                ids = keys.to_numpy()
                ranks = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
                places = np.ascontiguousarray(held.T.astype(np.int64) + np.arange(parts)[:, None] * books.shape[1])
                for q in range(len(queries)):
                    far = 2 * tables[q].take(places).sum(0)
                    far[(held == own[q]).all(1)] //= 2
                    other = np.flatnonzero(ids != queries[q].as_py())
                    if len(other) > limit:
                        other = other[far[other] <= np.partition(far[other], limit - 1)[limit - 1]]
                    best = other[np.lexsort((ranks[other], far[other]))[:limit]]
                    yield pa.RecordBatch.from_arrays([pa.array([queries[q].as_py()] * len(best), queries.type), keys.take(pa.array(best)), pa.array(far[best])], ["query", "key", "distance"])

    found = met.mapInArrow(run, f"query {query_type}, key {key_type}, distance long")
    return pick(found, "query", F.asc("distance"), F.asc("key"), n=limit).withColumnRenamed("key", key)


def reranked(found: DataFrame, df: DataFrame, asked: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """query, key, score: the k of the found pairs with the highest exact cosine; ties (at nine digits) go to the smaller key."""
    pairs = found.select("query", key).join(df.select(key, F.col(vector).alias("held")), key).join(asked.select("query", F.col("vector").alias("wanted")), "query")
    scored = pairs.select("query", key, cosine(F.col("wanted"), F.col("held")).alias("score"))
    return pick(scored, "query", F.desc(F.round("score", 9)), F.asc(key), n=k)


def quantised_search(df: DataFrame, asked: DataFrame, key: str, vector: str, books: np.ndarray, k: int = 10, shortlist_mult: int = 8, lists: np.ndarray | None = None, probes: int = 1) -> DataFrame:
    """query, key, score of the k nearest by cosine among each query's shortlist of k * shortlist_mult keys.

    asked: query, vector. The shortlist is taken by the quantiser's distances over all codes, or, with lists (a coarse
    codebook of one part), over those of the query's probes nearest lists alone. A key is never its own neighbour. Null
    keys, vectors and coordinates are left out; a query without candidates has no rows.
    """
    asked = _present(asked, "query", "vector").withColumnRenamed("key", "query")
    codes = coded(df, key, vector, books)
    if lists is None:
        everywhere = F.lit(0).cast("long").alias("group")
        found = shortlists(codes.withColumn("group", everywhere), asked.withColumn("group", everywhere), key, books, k * shortlist_mult)
    else:
        first = lambda c: F.ascii(F.unhex(F.hex(c))).cast("long")
        placed = coded(df, key, vector, lists).select(key, first("codes").alias("group"))
        found = shortlists(codes.join(placed, key), _probed(asked, lists, probes), key, books, k * shortlist_mult, max(1, SPREAD // lists.shape[1]))
    return reranked(found, df, asked, key, vector, k)


def _probed(asked: DataFrame, lists: np.ndarray, probes: int) -> DataFrame:
    """Every query once for each of the probes lists nearest to it (group)."""
    query_type = asked.schema["query"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                vectors = fixed(b.column(1))
                near = _distances(vectors[:, None, :], lists)[:, 0].argsort(1, kind="stable")[:, :probes]
                row = pa.array(np.repeat(np.arange(len(b)), near.shape[1]))
                yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array(near.ravel())], ["query", "vector", "group"])

    return asked.select("query", "vector").mapInArrow(run, f"query {query_type}, vector array<double>, group long")
