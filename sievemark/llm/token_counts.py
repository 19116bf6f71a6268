"""Token counts by rank-synchronous array merging.

The distinct pre-tokens of a batch are held as one ragged array of symbols. In each round every sequence's
lowest-rank pair is contracted at once (all its occurrences, left to right without overlap), until no sequence
has a ranked pair; the surviving symbols are counted.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretokens, ragged

NO_RANK = np.iinfo(np.int32).max


def byte_signs() -> list[str]:
    """The printable sign that byte-level vocabularies write for each byte: itself if visible, else the next code point from 256."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


class Merges:
    """The merges of a byte-level BPE vocabulary in tokenizers' JSON form."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.size = len(ids) + len(self.special)
        self.byte_ids = np.array([ids[s] for s in byte_signs()], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ", 1) for m in spec["model"]["merges"]]
        keys = np.array([ids[a] * self.size + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)[order]

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.size + right
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[i] == key, self.ranks[i], NO_RANK), self.merged[i]


def merge_all(symbols: np.ndarray, owner: np.ndarray, n: int, merges: Merges) -> np.ndarray:
    """Symbols left of each of the n sequences; owner is ascending and tells the sequence of each symbol."""
    left = np.bincount(owner, minlength=n).astype(np.int64)
    while len(symbols) > 1:
        same = owner[1:] == owner[:-1]
        rank, merged = merges.look_up(symbols[:-1], symbols[1:])
        rank = np.append(np.where(same, rank, NO_RANK), NO_RANK)
        heads = np.flatnonzero(np.append(True, ~same))
        least = np.minimum.reduceat(rank, heads)
        size = np.diff(np.append(heads, len(rank)))
        hit = (rank == np.repeat(least, size)) & (rank < NO_RANK)
        at = np.flatnonzero(hit)
        if not len(at):
            break
        fresh = np.append(True, np.diff(at) != 1)
        run = np.repeat(at[fresh], np.diff(np.append(np.flatnonzero(fresh), len(at))))
        at = at[(at - run) % 2 == 0]
        symbols[at] = merged[at]
        left -= np.bincount(owner[at], minlength=n)
        keep = np.repeat(least < NO_RANK, size)
        keep[at + 1] = False
        symbols, owner = symbols[keep], owner[keep]
    return left


@lru_cache(2)
def _state(path: str) -> tuple[Merges, pretokens.Known]:
    return Merges(path), pretokens.Known()


def count_slice(data: np.ndarray, offsets: np.ndarray, path: str) -> np.ndarray:
    """Tokens of each text. A special token's string counts as one token and ends the text before it."""
    merges, known = _state(path)
    marks = [s.encode() for s in merges.special]
    raw = data.tobytes()
    if any(m in raw for m in marks):
        out = np.zeros(len(offsets) - 1, np.int64)
        for i in range(len(out)):
            parts, special = [raw[offsets[i] : offsets[i + 1]]], 0
            for m in marks:
                cut = [p.split(m) for p in parts]
                special += sum(len(c) - 1 for c in cut)
                parts = [p for c in cut for p in c]
            ends = np.cumsum([0, *map(len, parts)])
            out[i] = special + _count(np.frombuffer(b"".join(parts), np.uint8), ends, merges, known).sum()
        return out
    return _count(data, offsets, merges, known)


def _count(data: np.ndarray, offsets: np.ndarray, merges: Merges, known: pretokens.Known) -> np.ndarray:
    starts, first = pretokens.cut(data, offsets)
    if not len(starts):
        return np.zeros(len(offsets) - 1, np.int64)
    names, s, e, back = pretokens.distinct(data, starts)
    counts, have = known.find(names)
    new = ~have
    if new.any():
        flat, owner = pretokens.gather(data, s[new], e[new])
        counts[new] = merge_all(merges.byte_ids[flat], owner, int(new.sum()), merges)
        known.add(names[new], counts[new])
    return ragged.sums(counts[back], first)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id_col, n_bytes, n_tokens, over_limit (n_tokens > limit).

    vocabulary: path of a byte-level BPE file in tokenizers' JSON form, readable on every executor.
    Null text counts as empty: 0 bytes, 0 tokens. Null ids, repeated rows and other columns are allowed; each row
    gives one row with these four columns. An empty table gives an empty result. Texts are taken whole, any length.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = ragged.texts_of(b.column(1))
            tokens, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, _, data, offsets in ragged.slices(texts):
                tokens.append(count_slice(data, offsets, vocabulary))
                sizes.append(np.diff(offsets))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(tokens))], ["id", "n_bytes", "n_tokens"])

    counted = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {id_type}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
