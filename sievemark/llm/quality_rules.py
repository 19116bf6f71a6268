"""Quality rules: fixed base rules, then gradient-boosted trees over document statistics.

The trees are grown here on labelled documents (logistic loss, histograms of quantile bins) and flattened into
numpy node arrays, so that scoring a batch is a few vectorised steps down all trees. Chosen statistics are bound
to act in one direction: more symbols, repeats or shouting never raise a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textstats
from .common import kept_rows

#: Most labelled documents that the trees are grown on (those with the smallest hashes of their ids).
TRAIN_ROWS = 20_000
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30

#: -1: a higher value never raises the score.
MONOTONE = {"symbol_share": -1, "symbol_word_share": -1, "upper_share": -1, "bang_rate": -1, "pipe_rate": -1, "dup_line_share": -1, "repeat_share": -1, "top_word_share": -1, "same_next_share": -1}


@dataclass
class Trees:
    """Complete binary trees of one depth in flat arrays; node i has the children 2i + 1 and 2i + 2."""

    feature: np.ndarray  # [tree, inner node]
    cut: np.ndarray
    value: np.ndarray  # [tree, leaf]
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability that a document is good."""
        total = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += value[node - inner]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, ridge: float = 1.0) -> Trees:
    """Boosted trees for 0/1 labels. signs[f]: -1 or 1 where feature f may only lower or raise the score."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)])
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    total, inner = np.full(len(x), base), 2**depth - 1
    out = Trees(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        node, limits = np.zeros(len(x), np.int64), {0: (-np.inf, np.inf)}
        for k in range(inner):
            here, (low, high) = np.flatnonzero(node == k), limits[k]
            best = (1e-6, None)
            whole_g, whole_h = g[here].sum(), h[here].sum()
            for f, e in enumerate(edges):
                if not len(e) or not len(here):
                    continue
                gs = np.cumsum(np.bincount(binned[here, f], g[here], len(e) + 1))[:-1]
                hs = np.cumsum(np.bincount(binned[here, f], h[here], len(e) + 1))[:-1]
                left, right = np.clip(gs / (hs + ridge), low, high), np.clip((whole_g - gs) / (whole_h - hs + ridge), low, high)
                gain = _gain(gs, hs, left, ridge) + _gain(whole_g - gs, whole_h - hs, right, ridge) - _gain(whole_g, whole_h, np.clip(whole_g / (whole_h + ridge), low, high), ridge)
                gain[((right - left) * signs[f] < 0) | (hs < 1) | (whole_h - hs < 1)] = 0
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (float(gain[i]), (f, i, float(left[i]), float(right[i])))
            limits[2 * k + 1] = limits[2 * k + 2] = (low, high)
            if best[1] is None:
                node[here] = 2 * k + 1
                continue
            f, i, left, right = best[1]
            out.feature[t, k], out.cut[t, k] = f, edges[f][i]
            node[here] = 2 * k + 1 + (binned[here, f] > i)
            if signs[f]:
                mid = (left + right) / 2
                below, above = (low, mid), (mid, high)
                limits[2 * k + 1], limits[2 * k + 2] = (below, above) if signs[f] > 0 else (above, below)
        for leaf in range(inner + 1):
            here = node == inner + leaf
            low, high = limits[inner + leaf]
            out.value[t, leaf] = rate * np.clip(g[here].sum() / (h[here].sum() + ridge), low, high)
            total[here] += out.value[t, leaf]
    return out


def _gain(g, h, value, ridge):
    return g * value - 0.5 * (h + ridge) * value * value


def _failed(n_words, n_repeat_words):
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> Trees | None:
    """Trees from at most max_rows labelled documents that pass the base rules; None without labels of both kinds."""
    chosen = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = textstats.counted(labelled).join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), *textstats.COUNTS).limit(max_rows).toPandas()
    rows = rows[~_failed(rows["n_words"], rows["n_repeat_words"])]
    y = (rows["quality"].to_numpy() > 0).astype(float)
    if not len(y) or y.min() == y.max():
        return None
    x = textstats.features({c: rows[c].to_numpy() for c in textstats.COUNTS})
    signs = np.array([MONOTONE.get(f, 0) for f in textstats.FEATURES])
    weighted = grow(x, y, signs)
    return weighted


def _judged(trees: Trees | None, counts: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """base_failed and score of each text."""
    return _failed(counts["n_words"], counts["n_repeat_words"]), trees.score(textstats.features(counts)) if trees else np.ones(len(counts["n_words"]))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_rows: int = TRAIN_ROWS) -> DataFrame:
    """Per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score.

    base_failed: fewer than 20 words, or over 30 % of the words in 8-word windows that return in the text. kept is
    false then, else whether the trees' score reaches threshold; without labels of both kinds there are no trees,
    and every document that passes the base rules is kept with score 1. Null text is an empty text (base_failed).
    Null ids, repeated rows and other columns are allowed: one row out for each row. Whole texts are read.
    """
    trees = fit(docs, labels, max_rows)

    def score(batches):
        for frame in batches:
            counts = {c: frame[c].to_numpy() for c in textstats.COUNTS}
            failed, value = _judged(trees, counts)
            yield pd.concat([frame[["doc_id", *textstats.COUNTS[:5]]], pd.DataFrame({"base_failed": failed, "kept": ~failed & (value >= threshold), "score": value}, index=frame.index)], axis=1)

    found = textstats.counted(docs)
    schema = T.StructType([*found.schema.fields[:6], T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("score", T.DoubleType())])
    return found.mapInPandas(score, schema)


def keep(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns, whatever their names, in one pass.

    Null and empty texts go (they fail the base rules); null ids and repeated rows are judged each by its text; an empty
    table gives an empty result.
    """
    trees = fit(docs, labels, max_rows)

    def fine(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        failed, value = _judged(trees, textstats.text_counts(data, offsets))
        return ~failed & (value >= threshold)

    return kept_rows(docs, fine)
