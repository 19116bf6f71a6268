"""Near-duplicate documents by a multi-index Hamming join of MinHash signatures.

A document's set of word shingles gets a signature of SYMBOLS short MinHash values. Two signatures within
DISTANCE differing symbols must, by the pigeonhole principle, agree up to DISTANCE // CHUNKS symbols in one of
CHUNKS chunks; so every document is indexed under each chunk with each choice of that many symbols left out,
and any pair within the distance meets under one key. At similarity 0.75 the chance that a pair's signatures
meet under no key is about 1e-6. Every link is confirmed on the full sets.

Groups of copies never become all their pairs: equal sets are folded into one representative first; then each
key links its members to one of them (a star), in ROUNDS rounds with other centres, which joins most groups;
only pairs that share a key but lie in different components after that are compared with each other. Pairs are
screened by a parity sketch of the sets: its differing bits never exceed the sets' symmetric difference, which
bounds the similarity from above, so that the screen loses no link.

A key may stay hot, where many documents share a passage and little else, or are copies of one with edits of their
own. Its members aren't paired with each other: a star is laid round the member whose shingles most others hold, then
the sets are put in one order, rare shingles first, and two sets of the similarity must share a shingle among the
first of each (as many as the similarity lets them differ in, and one), so that shingles of one document drop out
and only documents that share such a shingle are compared.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ragged
from .common import materialize, semi_join, shuffled

SHINGLE_WORDS = 5
SYMBOLS, CHUNKS, DISTANCE = 30, 6, 17
_CHUNK = SYMBOLS // CHUNKS
#: 64-bit words of a set's parity sketch, and rounds of stars.
SKETCH_WORDS, ROUNDS = 32, 2
#: A key with more pairs of sketches to compare is hot: up to so many are a few seconds of one task.
HOT_PAIRS = 20_000_000
#: For each chunk, the symbols of each key.
KEYS = [tuple(c * _CHUNK + i for i in kept) for c in range(CHUNKS) for kept in combinations(range(_CHUNK), _CHUNK - DISTANCE // CHUNKS)]

_rng = np.random.default_rng(75)
_FACTORS = _rng.integers(1, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _rng.integers(0, 2**63, SYMBOLS, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles (A-Z lower-cased), and each text's first one (one more at the end).

    A text of fewer than width words has its whole sequence as one shingle, a text without words none.
    """
    starts, ends, first = ragged.words(data, offsets)
    hashes = ragged.hashes(ragged.lower(data), starts, ends)
    out, begins = ragged.windows(hashes, first, width)
    counts = np.diff(first)
    short = np.flatnonzero((counts > 0) & (counts < width))
    sizes = np.diff(begins)
    if len(short):
        value = np.zeros(len(short), np.uint64)
        for j in range(width - 1):
            there = counts[short] > j
            value[there] = value[there] * np.uint64(0xD1342543DE82EF95) + hashes[first[short[there]] + j]
        value = ragged.mix(value + counts[short].astype(np.uint64))
        out = np.insert(out, begins[short], value)
        sizes[short] = 1
    owner = np.repeat(np.arange(len(sizes)), sizes)
    out = ragged.sort_within(out, np.concatenate([[0], np.cumsum(sizes)]))
    fresh = np.ones(len(out), bool)
    fresh[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    out, owner = out[fresh], owner[fresh]
    return out, np.searchsorted(owner, np.arange(len(sizes) + 1))


def minhash(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Signature rows (uint16) of the sets that aren't empty."""
    full = np.flatnonzero(np.diff(first))
    out = np.zeros((len(full), SYMBOLS), np.uint16)
    if len(full):
        for j in range(SYMBOLS):
            x = (values ^ _SHIFTS[j]) * _FACTORS[j]
            x ^= x >> np.uint64(29)
            x *= _FACTORS[-1 - j]
            least = np.minimum.reduceat(x, first[full])
            out[:, j] = (ragged.mix(least) >> np.uint64(40)).astype(np.uint16)
    return out


def parity_sketch(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SKETCH_WORDS 64-bit words for each set: bit i tells whether an odd number of its members fall on i."""
    bits = 64 * SKETCH_WORDS
    n = len(first) - 1
    place = np.repeat(np.arange(n), np.diff(first)) * bits + (ragged.mix(values ^ _SHIFTS[1]) % np.uint64(bits)).astype(np.int64)
    place, times = np.unique(place, return_counts=True)
    place = place[times % 2 == 1]
    out = np.zeros(n * SKETCH_WORDS, np.uint64)
    np.bitwise_or.at(out, place // 64, np.uint64(1) << (place % 64).astype(np.uint64))
    return out.view(np.int64).reshape(n, SKETCH_WORDS)


_SKETCH = [f"b{i}" for i in range(SKETCH_WORDS)]


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (hashes of the whole set), signature (SYMBOLS short values; null for an empty set), sketch."""

    def run(batches):
        for b in batches:
            texts = ragged.texts_of(b.column(1))
            for lo, hi, data, offsets in ragged.slices(texts):
                values, first = shingle_sets(data, offsets)
                sizes = np.diff(first)
                both = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(ragged.mix(v))]) for v in (values, values ^ _SHIFTS[0])]
                ends = np.concatenate([[0], np.cumsum(np.where(sizes > 0, SYMBOLS, 0))]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(minhash(values, first).view(np.int16).ravel()), mask=pa.array(sizes == 0))
                words = parity_sketch(values, first)
                sketch = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(words[:, i])) for i in range(SKETCH_WORDS)], _SKETCH)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(sizes.astype(np.int64)), *(pa.array((s[first[1:]] - s[first[:-1]]).view(np.int64)) for s in both), listed, sketch], ["doc_id", "n_shingles", "set_a", "set_b", "signature", "sketch"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    sketch = ", ".join(f"{b}: long" for b in _SKETCH)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {id_type}, n_shingles long, set_a long, set_b long, signature array<smallint>, sketch struct<{sketch}>")


def sets_of(docs: DataFrame, ids: DataFrame, n_ids: int) -> DataFrame:
    """doc_id, a hash of its whole set, and the sorted set, for the ids asked for; equal sets of one id once."""

    def run(batches):
        for b in batches:
            texts = ragged.texts_of(b.column(1))
            for lo, hi, data, offsets in ragged.slices(texts):
                values, first = shingle_sets(data, offsets)
                ends = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ragged.mix(values))])
                whole = pa.array((ends[first[1:]] - ends[first[:-1]]).view(np.int64))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), whole, pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.view(np.int64)))], ["doc_id", "whole", "shingles"])

    wanted = semi_join(docs.select("doc_id", F.col("text").cast("string").alias("text")), ids, "doc_id", n_ids)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return wanted.mapInArrow(run, f"doc_id {id_type}, whole long, shingles array<long>").dropDuplicates(["doc_id", "whole"])


def confirmed(docs: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose full sets have at least the similarity."""
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    sets = materialize(sets_of(docs, ids, ids.count()))
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_l"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_r"))
    common = F.size(F.array_intersect("set_l", "set_r")).cast("long")
    union = F.size("set_l") + F.size("set_r") - F.col("common")
    both = pairs.join(right, "b").join(left, "a").withColumn("common", common)
    return both.filter(100 * F.col("common") >= _percent(threshold) * union).select("a", "b")


def _percent(threshold: float) -> int:
    return int(round(threshold * 100))


def shared_shingles(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc_id, whole, size, shingle, holders: the shingles of nodes (doc_id) that several of them hold, written; size is that of the whole set."""
    sets = materialize(sets_of(docs, nodes, nodes.count()).withColumn("size", F.size("shingles").cast("long")))
    rows = sets.select("doc_id", "whole", "size", F.explode("shingles").alias("shingle"))
    held = rows.groupBy("shingle").agg(F.count("*").alias("holders")).filter("holders > 1")
    return materialize(rows.join(shuffled(held), "shingle"))


def prefix_pairs(common: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) that may have the similarity, of nodes of different components (doc_id, component), from their shared_shingles().

    Two sets of n and m shingles with the similarity share at least ceil(threshold n) of the first one's; so in any one
    order of all shingles they share one of the first n - ceil(threshold n) + 1 and m - ceil(threshold m) + 1. The order
    is by the number of nodes that hold a shingle; those of a single node come first and can't be shared. All that two
    sets share stands from the first shared shingle on: where that isn't enough in either, the pair is left out.
    """
    whole = Window.partitionBy("doc_id", "whole")
    alone = F.col("size") - F.count("*").over(whole)
    need = F.ceil(F.col("size") * _percent(threshold) / 100)
    placed = common.withColumn("place", alone + F.row_number().over(whole.orderBy("holders", "shingle")))
    prefix = materialize(placed.filter(F.col("place") <= F.col("size") - need + 1).join(labels, "doc_id").select("shingle", "doc_id", "size", "component", (F.col("size") - F.col("place") + 1).alias("ahead")))
    a, b = prefix.alias("a"), prefix.alias("b")
    # Similar sets share 100 c >= percent (n + m - c) shingles; of either at most those ahead.
    close = (100 + _percent(threshold)) * F.least("a.ahead", "b.ahead") >= _percent(threshold) * (F.col("a.size") + F.col("b.size"))
    met = a.join(shuffled(b), (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.doc_id") < F.col("b.doc_id")) & (F.col("a.component") != F.col("b.component")) & close)
    return met.select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """doc_id and component (its smallest id reachable) of every id in edges (a, b), by alternating large and small stars.

    Each round hangs every node's larger neighbours on its smallest one, then the smaller ones; it ends when a
    round changes nothing. All of it stays in tables; hot centres are pre-aggregated by min() and joined back.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    mark = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = materialize(small.filter("u <> v").distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first())
        if now == mark:
            break
        mark = now
    inner = edges.select(F.col("u").alias("doc_id"), F.col("v").alias("component"))
    return inner.union(edges.select(F.col("v").alias("doc_id"), F.col("v").alias("component")).distinct())


def _may_reach(a: str, b: str, threshold: float) -> F.Column:
    """False only where the set sizes (a.n, b.n) or the parity sketches (a.b0, ...) show a similarity below threshold.

    Sets of that similarity differ by at most (a.n + b.n)(1 - threshold)/(1 + threshold) members. Pairs of very large
    sets, whose sketches are full, pass.
    """
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    differ = sum((F.bit_count(F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}"))) for w in _SKETCH[1:]), F.bit_count(F.col(f"{a}.b0").bitwiseXOR(F.col(f"{b}.b0"))))
    most = (n + m) * ((1 - threshold) / (1 + threshold)) + 1e-6
    return (F.least(n, m) + 1e-6 >= threshold * F.greatest(n, m)) & (differ <= most)


def near_duplicates(docs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id (the smallest doc_id reachable), kept.

    Documents with a similarity of threshold or more (shared over all distinct shingles) are linked; kept is
    doc_id = component_id. Texts that are null, empty or without words have an empty set and are linked with
    nothing; texts of fewer than five words have their whole sequence as one shingle. Equal texts are linked
    whatever their number. Other columns are left out. A null doc_id is linked with nothing and is its own
    component (null), kept. Rows that repeat a doc_id are one document, linked where any of its texts is, with one
    component. An empty table gives an empty result. Texts are taken whole.
    """
    docs = docs.select("doc_id", "text")
    signed = materialize(signatures(docs))
    full = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    same = ["n_shingles", "set_a", "set_b"]
    reps = materialize(full.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("signature", "sketch"), "doc_id").alias("s")).select(*same, "rep", "s.signature", F.struct(F.col("n_shingles").alias("n"), "s.sketch.*").alias("sketch")))

    keys = [F.xxhash64(F.lit(k), *(F.element_at("signature", i + 1) for i in places)) for k, places in enumerate(KEYS)]
    indexed = reps.select("rep", F.explode(F.array(*keys)).alias("key"))
    shared = indexed.groupBy("key").agg(F.min("rep").alias("head"), F.max("rep").alias("tail")).filter("head < tail").select("key", "head")
    members = materialize(indexed.join(shuffled(shared), "key"))
    sketches = materialize(reps.select("rep", "sketch").join(shuffled(members.select("rep").distinct()), "rep"))  # several rows of an id with several sets
    labels = members.select(F.col("rep").alias("doc_id"), F.col("rep").alias("component")).distinct()
    screened = lambda pairs: pairs.join(_as(sketches, "b"), "b").join(_as(sketches, "a"), "a").filter(_may_reach("sketch_a", "sketch_b", threshold)).select("a", "b").distinct()
    edges = _of_one_id(full, reps, same)
    mixed = members.select("key", "rep", F.col("rep").alias("component"), F.col("head"), F.col("head").alias("head_component"))
    for turn in range(ROUNDS):
        if mixed.isEmpty():  # no key is shared by different components
            break
        stars = mixed.filter("component <> head_component").select(F.least("head", "rep").alias("a"), F.greatest("head", "rep").alias("b")).distinct()
        found = confirmed(docs, materialize(screened(stars)), threshold)
        edges = found if edges is None else edges.union(found)
        labels = materialize(components(edges))
        edges = labels.select(F.col("doc_id").alias("a"), F.col("component").alias("b"))
        labelled = members.select("key", "rep").join(labels.withColumnRenamed("doc_id", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
        centre = labelled.groupBy("key").agg(F.min_by(F.struct(F.col("rep").alias("head"), F.col("component").alias("head_component")), F.xxhash64("rep", "key", F.lit(turn))).alias("h"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key", "h.*")
        mixed = materialize(labelled.join(centre, "key"))

    main = mixed.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    main = materialize(main.select("key", "main", ((F.col("all") - F.col("most")) * F.col("all") > HOT_PAIRS).alias("hot")))
    mixed = mixed.select("key", "rep", "component").join(main, "key")
    hot = materialize(mixed.filter("hot").select(F.col("rep").alias("doc_id")).distinct())
    cold = mixed.filter("NOT hot").join(sketches, "rep")
    minor = cold.filter("component <> main").select("key", F.col("rep").alias("x"), F.col("component").alias("cx"), F.col("sketch").alias("sx"))
    every = cold.select("key", F.col("rep").alias("y"), F.col("component").alias("cy"), F.col("sketch").alias("sy"), "main")
    apart = (F.col("cx") < F.col("cy")) | ((F.col("cx") > F.col("cy")) & (F.col("cy") == F.col("main")))
    met = minor.join(every, (minor["key"] == every["key"]) & apart & _may_reach("sx", "sy", threshold)).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    if not hot.isEmpty():
        # One more star of each hot key, round the member whose shingles most others hold: copies with edits of their own hang on what they are copies of.
        common = shared_shingles(docs, hot)
        weight = common.groupBy(F.col("doc_id").alias("rep")).agg((F.sum("holders") / F.max("size")).alias("weight"))
        weighed = mixed.filter("hot").select("key", "rep", "component").join(weight, "rep")
        middle = weighed.groupBy("key").agg(F.max_by(F.struct(F.col("rep").alias("head"), F.col("component").alias("head_component")), F.struct("weight", "rep")).alias("h")).select("key", "h.*")
        stars = weighed.join(middle, "key").filter("component <> head_component").select(F.least("head", "rep").alias("a"), F.greatest("head", "rep").alias("b")).distinct()
        labels = materialize(components(edges.union(confirmed(docs, materialize(screened(stars)), threshold))))
        edges = labels.select(F.col("doc_id").alias("a"), F.col("component").alias("b"))
        labelled = hot.join(labels, "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"))
        met = met.union(screened(prefix_pairs(common, labelled, threshold)))
    rest = materialize(met.distinct())
    if not rest.isEmpty():
        labels = components(edges.union(confirmed(docs, rest, threshold)))
    elif turn == 0 and edges is not None:  # only ids of several texts are linked
        labels = components(edges)

    placed = reps.select("rep", *same).join(shuffled(labels.withColumnRenamed("doc_id", "rep")), "rep", "left").select(*same, F.coalesce("component", "rep").alias("component_id"))
    found = full.select("doc_id", *same).join(shuffled(placed), same).select("doc_id", "n_shingles", "component_id")
    alone = signed.filter("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _of_one_id(full: DataFrame, reps: DataFrame, same: list[str]) -> DataFrame | None:
    """Links between the representatives of ids that several different texts share; None where every id has one text."""
    several = materialize(full.groupBy("doc_id").agg(F.min("set_a").alias("low"), F.max("set_a").alias("high")).filter("low < high").select("doc_id"))
    if several.isEmpty():
        return None
    held = full.join(several, "doc_id", "left_semi").join(reps.select(*same, "rep"), same).select("doc_id", "rep")
    return held.join(held.groupBy("doc_id").agg(F.min("rep").alias("least")), "doc_id").filter("rep <> least").select(F.col("least").alias("a"), F.col("rep").alias("b"))


def _as(sketches: DataFrame, side: str) -> DataFrame:
    return sketches.select(F.col("rep").alias(side), F.col("sketch").alias(f"sketch_{side}"))
