"""Quality classifier from weak labels.

Overlapping heuristic labellers vote on every document (junk, no vote, fine). Expectation-maximisation over the
counts of vote patterns, of which there are few whatever the input, estimates how often each labeller votes what on
fine and on junk documents, the share of fine ones, and each pattern's posterior. The posteriors of a bounded sample train a linear scorer on hashed features (words, and
ranges of text statistics), which scores every document.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ragged, textstats
from .common import kept_rows, materialize

#: Most documents that the scorer is trained on (those with the smallest hashes of their ids), and hashed features.
TRAIN_ROWS, DIMENSIONS = 6_000, 1 << 15

LABELLERS = ["bangs", "capitals", "symbols", "marks", "tables", "repeats", "dup_lines", "richness", "variety", "sentences"]
#: What is believed before any document is seen, as if so large a share of all documents (WEIGHT) had shown it: the share of
#: fine documents (a Beta prior), and how often a labeller votes junk, not, or fine on junk and on fine ones (Dirichlet priors).
FINE_SHARE, WEIGHT = 0.9, 0.02
BELIEF = np.array([[0.2, 0.6, 0.2], [0.002, 0.498, 0.5]])
JUNK, NO_VOTE, FINE = 0, 1, 2
_RANGES = np.array([0.002, 0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97])


def votes(x: np.ndarray) -> np.ndarray:
    """One vote of each labeller for each row of textstats.features(). Some only ever vote for junk, some either way."""
    f = dict(zip(textstats.FEATURES, x.T))
    enough = f["log_words"] >= np.log1p(8)
    # Herdan's measure: the logarithm of the distinct words over that of all words.
    rich = np.log(np.maximum(f["distinct_share"] * np.expm1(f["log_words"]), 1)) / np.maximum(f["log_words"], 1)
    junk = lambda said: np.where(said & enough, JUNK, NO_VOTE)
    return np.column_stack([
        junk(f["bang_rate"] > 0.2),
        np.where((f["upper_share"] < 0.3) & enough, FINE, junk(f["upper_share"] > 0.5)),
        junk((f["symbol_word_share"] > 0.12) & (f["pipe_rate"] < 0.1)),
        np.where((f["symbol_share"] < 0.004) & enough, FINE, junk(f["symbol_share"] > 0.015)),
        junk(f["pipe_rate"] > 0.1),
        junk((f["repeat_share"] > 0.5) | (f["same_next_share"] > 0.2)),
        junk(f["dup_line_share"] > 0.5),
        np.where((rich > 0.85) & enough, FINE, junk(rich < 0.7)),
        np.where(f["top_word_share"] < 0.2, FINE, junk(f["top_word_share"] > 0.35)),
        np.where((f["end_rate"] > 0.01) & (f["end_rate"] < 0.5), FINE, junk(((f["end_rate"] > 0.8) | (f["end_rate"] == 0)) & (f["log_words"] > np.log1p(60)))),
    ])


def packed(v: np.ndarray) -> np.ndarray:
    return v @ (3 ** np.arange(v.shape[1]))


def unpacked(codes: np.ndarray) -> np.ndarray:
    return codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


def estimate(codes: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over vote patterns: P(fine) of each pattern, P(vote | class) as table[class, labeller, vote], and the share of fine documents.

    A labeller's silence counts like its votes. The priors are BELIEF and FINE_SHARE; it begins with junk where any labeller says so.
    """
    v, n = unpacked(codes), counts.sum()
    post = np.where((v == JUNK).any(1), 0.02, 0.99)
    believed = WEIGHT * n * np.array([[1 - FINE_SHARE], [FINE_SHARE]]) * BELIEF + 1e-6
    table, share, each = np.zeros((2, v.shape[1], 3)), FINE_SHARE, np.arange(v.shape[1])
    for _ in range(rounds):
        weight = np.stack([counts * (1 - post), counts * post])
        for k in range(3):
            table[:, :, k] = weight @ (v == k) + believed[:, k : k + 1]
        table /= table.sum(2, keepdims=True)
        share = (weight[1].sum() + WEIGHT * n * FINE_SHARE) / (n + WEIGHT * n)
        said = (np.log(table[1, each, v]) - np.log(table[0, each, v])).sum(1)
        post = 1 / (1 + np.exp(-np.clip(np.log(share / (1 - share)) + said, -30, 30)))
    return post, table, share


def accuracies(table: np.ndarray, share: float) -> np.ndarray:
    """The share of each labeller's votes that are right, silence left out."""
    junk, fine = (1 - share) * table[0], share * table[1]
    return (junk[:, JUNK] + fine[:, FINE]) / (junk[:, JUNK] + fine[:, FINE] + junk[:, FINE] + fine[:, JUNK])


def hashed(data: np.ndarray, offsets: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature ids, values and text indices: each word by its share, and the range of each statistic."""
    starts, ends, first = ragged.words(data, offsets)
    owner = ragged.owners(first)
    ids = (ragged.hashes(ragged.lower(data), starts, ends) % np.uint64(DIMENSIONS)).astype(np.int64)
    n = len(offsets) - 1
    place, times = np.unique(owner * DIMENSIONS + ids, return_counts=True)
    owner, ids = place // DIMENSIONS, place % DIMENSIONS
    size = np.maximum(np.diff(first), 1)[owner]
    rows, cols = np.repeat(np.arange(n), x.shape[1] - 2), np.tile(np.arange(2, x.shape[1]), n)
    ranges = np.searchsorted(_RANGES, x[:, 2:].ravel())
    stat = (ragged.mix((cols * 64 + ranges).astype(np.uint64)) % np.uint64(DIMENSIONS)).astype(np.int64)
    return np.concatenate([ids, stat]), np.concatenate([times / size, np.ones(len(stat))]), np.concatenate([owner, rows])


def train(ids: np.ndarray, values: np.ndarray, owner: np.ndarray, target: np.ndarray, steps: int = 150, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Weights (the last one is the constant) of a logistic scorer for soft targets, by full-batch Adagrad; both classes weigh alike."""
    n = len(target)
    w, seen = np.zeros(DIMENSIONS + 1), np.full(DIMENSIONS + 1, 1e-8)
    if not n:
        w[-1] = 1.0
        return w
    fine, junk = max(target.sum(), 1e-9), max((1 - target).sum(), 1e-9)
    weight = np.minimum(target / fine + (1 - target) / junk, 10 * 2 / n) / 2
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, values * w[ids], n) + w[-1], -30, 30)))
        miss = weight * (p - target)
        slope = np.append(np.bincount(ids, values * miss[owner], DIMENSIONS), miss.sum()) + decay * w / 2
        seen += slope**2
        w -= rate * slope / np.sqrt(seen)
    return w


def _each(batches, cols):
    for b in batches:
        texts = ragged.texts_of(b.column(len(cols)))
        for lo, hi, data, offsets in ragged.slices(texts):
            yield [b.column(i).slice(lo, hi - lo) for i in range(len(cols))], data, offsets, textstats.features(textstats.text_counts(data, offsets))


def _voted(docs: DataFrame) -> tuple[DataFrame, pd.DataFrame]:
    """The vote pattern of every document, written, and the count of each pattern."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def vote(batches):
        for (ids,), _, _, x in _each(batches, ["doc_id"]):
            yield pa.RecordBatch.from_arrays([ids, pa.array(packed(votes(x)))], ["doc_id", "pattern"])

    voted = materialize(docs.mapInArrow(vote, f"doc_id {id_type}, pattern long"))
    return voted, voted.groupBy("pattern").count().toPandas().sort_values("pattern")  # at most 3^labellers rows


def labellers(docs: DataFrame) -> pd.DataFrame:
    """The labellers as EM sees them over all docs (doc_id, text): labeller, votes_junk, votes_fine, accuracy. Without documents no rows."""
    _, counts = _voted(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    if counts.empty:
        return pd.DataFrame(columns=["labeller", "votes_junk", "votes_fine", "accuracy"])
    v, n = unpacked(counts["pattern"].to_numpy()), counts["count"].to_numpy()
    _, table, share = estimate(counts["pattern"].to_numpy(), n.astype(float))
    return pd.DataFrame({"labeller": LABELLERS, "votes_junk": n @ (v == JUNK), "votes_fine": n @ (v == FINE), "accuracy": accuracies(table, share)})


def _learn(docs: DataFrame, max_rows: int) -> tuple[dict[int, float], np.ndarray]:
    """Posterior of each vote pattern, and the scorer's weights."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    voted, counts = _voted(docs)
    codes = counts["pattern"].to_numpy()
    posterior = estimate(codes, counts["count"].to_numpy().astype(float))[0] if len(codes) else np.zeros(0)
    of_code = dict(zip(codes.tolist(), posterior.tolist()))

    by_hash = voted.select(F.xxhash64("doc_id").alias("h")).orderBy("h").limit(max_rows).agg(F.max("h")).first()[0]

    def featurise(batches):
        for (ids,), data, offsets, x in _each(batches, ["doc_id"]):
            f, v, owner = hashed(data, offsets, x)
            order = np.argsort(owner, kind="stable")
            bounds = np.searchsorted(owner[order], np.arange(len(x) + 1)).astype(np.int32)
            listed = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(a[order].astype(kind))) for a, kind in ((f, np.int32), (v, np.float32))]
            yield pa.RecordBatch.from_arrays([ids, *listed, pa.array(packed(votes(x)))], ["doc_id", "ids", "vals", "pattern"])

    chosen = docs.filter(F.xxhash64("doc_id") <= F.lit(by_hash)) if by_hash is not None else docs.limit(0)
    sample = chosen.mapInArrow(featurise, f"doc_id {id_type}, ids array<int>, vals array<float>, pattern long").orderBy(F.xxhash64("doc_id"), "pattern").limit(max_rows).drop("doc_id").toArrow()  # at most max_rows rows
    flat = lambda c: sample[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(sample)), pc.list_value_length(sample["ids"]).to_numpy())
    return of_code, train(flat("ids"), flat("vals"), owner, np.array([of_code[c] for c in sample["pattern"].to_pylist()], float)).astype(np.float32)


def _scores(weights: np.ndarray, data: np.ndarray, offsets: np.ndarray, x: np.ndarray) -> np.ndarray:
    f, v, own = hashed(data, offsets, x)
    total = np.bincount(own, v * weights[f], len(x)) + weights[-1]
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def classify(docs: DataFrame, threshold: float = 0.5, max_rows: int = TRAIN_ROWS) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, votes_junk, votes_fine, posterior (of the weak-label model), score, kept (score >= threshold).

    Null or empty texts get the labellers' votes for an empty text. Null ids, repeated rows and other columns are
    allowed: one row out for each row; an empty table gives an empty result. All documents are counted and scored,
    whole; only the scorer's weights come from at most max_rows documents.
    """
    of_code, weights = _learn(docs, max_rows)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def score(batches):
        for (ids,), data, offsets, x in _each(batches, ["doc_id"]):
            said, value = votes(x), _scores(weights, data, offsets, x)
            post = pd.Series(packed(said)).map(of_code).to_numpy(dtype=float)
            yield pa.RecordBatch.from_arrays([ids, pa.array((said == JUNK).sum(1)), pa.array((said == FINE).sum(1)), pa.array(post), pa.array(value), pa.array(value >= threshold)], ["doc_id", "votes_junk", "votes_fine", "posterior", "score", "kept"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(score, f"doc_id {id_type}, votes_junk long, votes_fine long, posterior double, score double, kept boolean")


def keep(docs: DataFrame, threshold: float = 0.5, max_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs that classify() keeps, with all their columns, whatever their names, in one pass.

    Null and empty texts, null ids and repeated rows are judged as by classify(), each row by its text; an empty table
    gives an empty result.
    """
    weights = _learn(docs, max_rows)[1]
    return kept_rows(docs, lambda data, offsets: _scores(weights, data, offsets, textstats.features(textstats.text_counts(data, offsets))) >= threshold)
