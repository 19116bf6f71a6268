"""Importance resampling of documents towards a target distribution of hashed word runs.

Runs of one to three words fall into BUCKETS by their CRC-32, which is put together from the words' own checksums in
numpy arrays, without writing the runs down. A document's weight is the sum of its buckets' gains; Gumbel noise from
its id makes the highest scores a draw without replacement.

The draw is ranked without a global sort: tasks write sorted runs of eligible rows, cut at bounds that deal the keys
to ranges of like size; a range's runs come in chunks in the order of their first keys, and a tournament tree merges
them. A chunk enters the tree when the merge has come to its first key, so that a task holds one chunk of each run,
whatever the size of the range. Exact counts of the ranges give each its first rank, and the last range's merge stops
ranking after the exact draw count. Ranges behind it are never merged.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ragged
from .common import materialize

BUCKETS, LONGEST_RUN = 10_000, 3
SEED, MIN_WORDS = 42, 20
#: Rows of a range, on average; of a chunk; and of a sorted run, at most.
RANGE_ROWS, CHUNK_ROWS, RUN_ROWS = 100_000, 2_048, 300_000
#: Words up to so many bytes are hashed side by side, longer ones one by one.
SIDE_BY_SIDE = 48

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True

#: Fixed value: the reflected CRC-32 polynomial.
_POLYNOMIAL = np.uint32(0xEDB88320)


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ _POLYNOMIAL, out >> 1)
    return out.astype(np.uint32)


_TABLE = _crc_table()


def _applied(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given for each byte at each of the four places."""
    byte = lambda k: (crc >> np.uint32(8 * k)) & np.uint32(255)
    return tables[0, byte(0)] ^ tables[1, byte(1)] ^ tables[2, byte(2)] ^ tables[3, byte(3)]


def _shift_tables() -> tuple[np.ndarray, np.ndarray]:
    """Maps of a checksum over n zero bytes more: for n up to 63, and for n of 64, 128, 256 ..."""
    one = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    near = [one]
    for _ in range(64):
        near.append(_TABLE[near[-1] & np.uint32(255)] ^ (near[-1] >> np.uint32(8)))
    far = [near.pop()]
    for _ in range(25):
        far.append(_applied(far[-1], far[-1].ravel()).reshape(4, 256))
    return np.stack(near), np.stack(far)


_NEAR, _FAR = _shift_tables()


def shifted(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The checksums' part in those of texts that go on for size bytes more."""
    low = size & 63
    out = np.zeros(len(crc), np.uint32)
    for k in range(4):
        out ^= _NEAR[low, k, (crc >> np.uint32(8 * k)) & np.uint32(255)]
    for j in range(int(size.max(initial=0)).bit_length() - 6):
        at = np.flatnonzero((size >> (6 + j)) & 1)
        out[at] = _applied(_FAR[j], out[at])
    return out


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of each byte range."""
    size = ends - starts
    order = np.argsort(-np.minimum(size, SIDE_BY_SIDE + 1), kind="stable")
    begin, length = starts[order], size[order]
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    alone = int(np.count_nonzero(length > SIDE_BY_SIDE))
    counts = np.bincount(np.minimum(length, SIDE_BY_SIDE + 1), minlength=SIDE_BY_SIDE + 2)
    upto = len(length) - np.cumsum(counts)  # ranges longer than each size
    for i in range(SIDE_BY_SIDE):
        n = int(upto[i])
        if n <= alone:
            break
        part = crc[alone:n]
        crc[alone:n] = _TABLE[(part ^ data[begin[alone:n] + i]) & np.uint32(255)] ^ (part >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    raw = memoryview(np.ascontiguousarray(data))
    crc[:alone] = [zlib.crc32(raw[a : a + n]) for a, n in zip(begin[:alone].tolist(), length[:alone].tolist())]
    out = np.empty(len(order), np.uint32)
    out[order] = crc
    return out


_SPACE = np.uint32(zlib.crc32(b" "))


def run_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Each text's first word (one more at the end), and for each run length the places of its first words and the buckets."""
    data = ragged.lower(data)
    starts, ends = ragged.spans(_WORD[data], offsets)
    first = np.searchsorted(starts, offsets)
    crc, size = checksums(data, starts, ends), ends - starts
    last = first[1:][ragged.owners(first)]  # the end of each word's text
    spaced = shifted(np.full(len(crc), _SPACE), size) ^ crc
    at, run, out = np.arange(len(crc)), crc, []
    for n in range(1, LONGEST_RUN + 1):
        out.append((at, (run % np.uint32(BUCKETS)).astype(np.int64)))
        goes_on = at + n < last[at]
        at, run = at[goes_on], run[goes_on]
        run = shifted(run, size[at + n] + 1) ^ spaced[at + n]
    return first, out


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many runs of all texts (a column text) fall in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for _, _, data, offsets in ragged.slices(ragged.texts_of(b.column(0))):
                for _, buckets in run_buckets(data, offsets)[1]:
                    found += np.bincount(buckets, minlength=BUCKETS)
        there = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(found[there])], ["bucket", "n"])

    counted = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in counted.collect():  # BUCKETS rows at most
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's share in the target over that in the source, one run added to each bucket."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def noise(doc_id: int | None) -> int:
    """floor of 1000 times Gumbel noise of an id (null: like an empty one)."""
    h = int(hashlib.sha256(f"{SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, and place: a double that never falls along score descending, doc_id ascending (null last)."""
    least, most = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    wide = 1 if least is None else most - least + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = ragged.texts_of(b.column(1))
            for lo, hi, data, offsets in ragged.slices(texts):
                first, runs = run_buckets(data, offsets)
                words = np.diff(first)
                weight = np.zeros(hi - lo, np.int64)
                for at, buckets in runs:
                    weight += ragged.sums(gain[buckets], np.searchsorted(at, first))
                features = sum(np.maximum(words - n, 0) for n in range(LONGEST_RUN))
                ids = b.column(0).slice(lo, hi - lo)
                listed = ids.to_pylist()
                score = weight + np.array([noise(i) for i in listed], np.int64)
                share = np.array([1.0 if i is None else (i - least) / wide for i in listed])
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, (words, features, weight, score, share - score))], ["doc_id", "n_words", "n_features", "weight", "score", "place"])

    fields = ", ".join(f"{c} long" for c in ("doc_id", "n_words", "n_features", "weight", "score"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"{fields}, place double")


_ROW = ["doc_id", "n_features", "weight", "score"]
_LISTS = ", ".join(f"{c} array<long>" for c in _ROW)


def sorted_runs(rows: DataFrame, bounds: list[float]) -> DataFrame:
    """Chunks of sorted runs of the rows up to the last bound: section (number of the range), the first key (lead_score, lead_id), rows, and their columns as lists."""
    ends = np.array(bounds)

    def written(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).filter(pc.less_equal(pa.Table.from_batches(batches)["place"], ends[-1]))
        ids = table["doc_id"].fill_null(0).to_numpy()
        absent, score, section = table["doc_id"].is_null().to_numpy(), table["score"].to_numpy(), np.searchsorted(ends, table["place"].to_numpy())
        table = table.take(pa.array(np.lexsort((ids, absent, -score, section))))
        section.sort()
        cuts = np.flatnonzero(np.diff(section, prepend=-1))
        for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(section)]):
            for lo in range(a, z, CHUNK_ROWS):
                part = table.slice(lo, min(CHUNK_ROWS, z - lo))
                whole = [pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part[c].combine_chunks()) for c in _ROW]
                yield pa.RecordBatch.from_arrays([pa.array([int(section[lo])], pa.int32()), part["score"][:1].combine_chunks(), part["doc_id"][:1].combine_chunks(), pa.array([len(part)], pa.int64()), *whole], ["section", "lead_score", "lead_id", "rows", *_ROW])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for b in batches:
            waiting.append(b)
            if sum(map(len, waiting)) >= RUN_ROWS:
                yield from written(waiting)
                waiting = []
        if waiting:
            yield from written(waiting)

    return rows.select(*_ROW, "place").mapInArrow(run, f"section int, lead_score long, lead_id long, rows long, {_LISTS}")


_LAST = (math.inf,)


class Tournament:
    """The least head of several sorted runs: a complete binary tree whose nodes hold the winner's slot."""

    def __init__(self):
        self.leaves, self.heads, self.best, self.free, self.rest = 1, [_LAST], [0, 0], [0], [iter(())]

    def _replay(self, slot: int) -> None:
        best, heads, at = self.best, self.heads, (self.leaves + slot) // 2
        while at:
            left, right = best[2 * at], best[2 * at + 1]
            best[at] = left if heads[left] <= heads[right] else right
            at //= 2

    def add(self, rows: Iterator[tuple]) -> None:
        """A sorted run of tuples."""
        if not self.free:
            n = self.leaves
            self.free, self.heads, self.rest = list(range(n, 2 * n)), self.heads + [_LAST] * n, self.rest + [iter(())] * n
            self.leaves = 2 * n
            self.best = [0] * self.leaves + list(range(self.leaves))
            for slot in range(self.leaves):
                self._replay(slot)
        slot = self.free.pop()
        self.rest[slot] = rows
        self.heads[slot] = next(rows, _LAST)
        if self.heads[slot] is _LAST:
            self.free.append(slot)
        self._replay(slot)

    def head(self) -> tuple:
        return self.heads[self.best[1]]

    def pop(self) -> tuple:
        slot = self.best[1]
        out = self.heads[slot]
        self.heads[slot] = next(self.rest[slot], _LAST)
        if self.heads[slot] is _LAST:
            self.free.append(slot)
        self._replay(slot)
        return out

    def left(self) -> Iterator[tuple]:
        """What wasn't popped, in no order."""
        for head, rows in zip(self.heads, self.rest):
            yield from () if head is _LAST else (head, *rows)


def merged(chunks: Iterable[tuple[tuple, Iterator[tuple]]], most: int) -> Iterator[tuple]:
    """The rows of all chunks, the first most of them in order. Chunks (first key, rows) come by first key; of one run, none begins before the one before it ends."""
    tree, n = Tournament(), 0
    for lead, rows in chunks:
        while n < most and tree.head() < lead:
            yield tree.pop()
            n += 1
        if n < most:
            tree.add(rows)
        else:
            yield from rows
    while n < most and tree.head() is not _LAST:
        yield tree.pop()
        n += 1
    yield from tree.left()


def _key(score: int, doc_id: int | None) -> tuple:
    return (-score, doc_id is None, doc_id or 0)


def ranked(chunks: DataFrame, starts: dict[int, int], draw: int) -> DataFrame:
    """The rows of sorted runs with their ranks, null beyond draw; starts: the number of rows before each section."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for i in range(len(b)):
                ids, features, weight, score = (b.column(4 + k)[i].values for k in range(4))
                yield b.column(0)[i].as_py(), _key(b.column(1)[i].as_py(), b.column(2)[i].as_py()), (ids, features, weight, score)

    def rows_of(ids: pa.Array, features: pa.Array, weight: pa.Array, score: pa.Array) -> Iterator[tuple]:
        return ((*_key(s, d), f, w) for d, f, w, s in zip(ids.to_pylist(), features.to_pylist(), weight.to_pylist(), score.to_pylist()))

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for section, part in groupby(listed(batches), lambda chunk: chunk[0]):
            rows = merged(((lead, rows_of(*columns)) for _, lead, columns in part), draw - starts[section])
            for place, row in enumerate(rows, starts[section] + 1):
                yield (None if row[1] else row[2], row[3], row[4], -row[0], place if place <= draw else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        for row in ordered(batches):
            waiting.append(row)
            if len(waiting) == 10_000:
                yield _batch(waiting)
                waiting = []
        if waiting:
            yield _batch(waiting)

    dealt = chunks.repartition(len(starts), "section").sortWithinPartitions("section", F.desc("lead_score"), F.asc_nulls_last("lead_id"))
    return dealt.mapInArrow(run, ", ".join(f"{c} long" for c in [*_ROW, "rank"]))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], [*_ROW, "rank"])


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_features, weight, score, rank (all long).

    Of the N rows with min_words words or more, floor(percent N / 100) of the highest scores are drawn and ranked from 1
    on, ties going to the smaller doc_id (null last); all others have no rank. weight sums floor(1000 ln) of how much
    more often target (a column text) has each bucket of the row's runs of one to three words than docs has; score adds
    noise from the doc_id (null: like an empty id). A null text is like an empty one: no runs, weight 0, no rank. Rows
    that repeat are rows each, next to each other in rank; equal scores and ids are in no order among each other. An
    empty target gives every bucket the same share; no rows in, no rows out. Other columns are left out.
    """
    docs = docs.select("doc_id", "text")
    rows = materialize(scored(docs, gains(bucket_counts(docs), bucket_counts(target))))
    eligible = rows.filter(F.col("n_words") >= min_words)
    n = eligible.count()
    draw = percent * n // 100
    unranked = [*_ROW, F.lit(None).cast("long").alias("rank")]
    if not draw:
        return rows.select(*unranked)
    share = 2.0
    while True:
        # Bounds need not be exact, the counts of their ranges are; they reach over twice the draw, so that it ends before the last one.
        parts = -(-draw // RANGE_ROWS)
        places = [min(1.0, share * draw / n * i / (2 * parts)) for i in range(1, 2 * parts + 1)]
        bounds = sorted(set(eligible.agg(F.percentile_approx("place", places, max(10_000, 20 * parts))).first()[0]))
        chunks = materialize(sorted_runs(eligible, bounds))
        sizes = dict(chunks.groupBy("section").agg(F.sum("rows")).collect())  # one row a range
        if sum(sizes.values()) >= draw:
            break
        share *= 2
    starts, before = {}, 0
    for section in sorted(sizes):
        if before >= draw:
            break
        starts[section], before = before, before + sizes[section]
    last = max(starts)
    found = ranked(chunks.filter(F.col("section") <= last), starts, draw)
    rest = rows.filter((F.col("n_words") < min_words) | (F.col("place") > bounds[last]))
    return found.unionByName(rest.select(*unranked))
