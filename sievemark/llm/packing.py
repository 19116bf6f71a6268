"""Packing of documents into sequences: first-fit decreasing in randomised groups.

Documents are tokenised and cut into pieces of at most one sequence. The pieces are dealt at random into groups
whose number follows the count of pieces; each group is packed alone by first-fit decreasing, where a tournament
tree over the free room of its bins finds the first bin that fits in logarithmic time.
"""

from __future__ import annotations

import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretokens, ragged
from .common import materialize

#: Pieces of one randomised group, on average.
GROUP_PIECES = 6_000
#: Words kept between batches, and words handed to the tokenizer at once (its results take about a kilobyte each).
KEPT_WORDS, BATCH_WORDS = 600_000, 2_000


class Tournament:
    """Free room of n bins in a complete binary tree whose nodes hold the most room below them."""

    def __init__(self, n: int, room: int):
        self.leaves = 1 << max(0, (n - 1).bit_length())
        self.most = [room] * (2 * self.leaves)

    def first_fit(self, need: int) -> int:
        """The first bin with room for need; takes that room."""
        most, at = self.most, 1
        while at < self.leaves:
            at *= 2
            if most[at] < need:
                at += 1
        bin_, left = at - self.leaves, most[at] - need
        most[at] = left
        while at > 1:
            at //= 2
            best = max(most[2 * at], most[2 * at + 1])
            if most[at] == best:
                break
            most[at] = best
        return bin_


def first_fit_decreasing(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece (1 to room long); ties keep their order, bins are numbered without gaps."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree = Tournament(max(1, len(lengths)), room)
    used: dict[int, int] = {}
    for i in order.tolist():
        n = int(lengths[i])
        b = tree.first_fit(n)
        bins[i], offsets[i] = b, used.get(b, 0)
        used[b] = used.get(b, 0) + n
    return bins, offsets


class Encoder:
    """Ids of whole texts from the tokenizers library, word by word.

    The vocabulary's rule never joins what white space divides, so that a text's ids are those of its words in
    order, and a word that returns needs no second encoding.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.known, self.kept = pretokens.Known(1 << 40), ragged.Lists(np.uint32)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and where each text's begin (one more at the end)."""
        starts, ends, first = ragged.words(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        names, s, e, back = pretokens.distinct(data, starts, ends)
        if len(self.kept) + len(names) > KEPT_WORDS:
            self.forget()
        at, have = self.known.find(names)
        new = np.flatnonzero(~have)
        if len(new):
            raw = data.tobytes()
            at[new] = len(self.kept) + np.arange(len(new))
            self.known.add(names[new], at[new])
            for i in range(0, len(new), BATCH_WORDS):
                some = new[i : i + BATCH_WORDS]
                found = self.tokenizer.encode_batch([raw[a:b].decode() for a, b in zip(s[some].tolist(), e[some].tolist())], add_special_tokens=False)
                size = np.array([len(x.ids) for x in found], np.int64)
                self.kept.add(np.fromiter(chain.from_iterable(x.ids for x in found), np.uint32, size.sum()), size)
        ids, ends = self.kept.take(at[back])
        return ids, ends[first]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, vocabulary: str, room: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece of a document: id_col, start, length, ids_crc32, doc_tokens. Each text ends with end_id; cuts are at multiples of room."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = ragged.texts_of(b.column(1))
            for lo, hi, data, offsets in ragged.slices(texts):
                ids, bounds = encoder(vocabulary).encode(data, offsets)
                rows = []
                for i in range(hi - lo):
                    doc = np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end_id)).astype("<u4")
                    rows += [(i, at, len(p := doc[at : at + room]), zlib.crc32(p.tobytes()), len(doc)) for at in range(0, len(doc), room)]
                owner, start, length, crc, total = (np.array(c, np.int64) for c in zip(*rows))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner + lo)), *map(pa.array, (start, length, crc, total))], ["id", "start", "length", "ids_crc32", "doc_tokens"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {id_type}, start long, length long, ids_crc32 long, doc_tokens long")
    return out.withColumnRenamed("id", id_col)


def pack(docs: DataFrame, vocabulary: str, room: int = 4096, end_id: int = 2, group_pieces: int = GROUP_PIECES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null text is an empty document of one id (end_id). Null ids and repeated rows are packed like any other row,
    spread over the groups; other columns are left out; an empty table gives an empty result. Documents longer than room are cut at its
    multiples. A group's bins never meet another's, so sequence_id = group * 2^32 + bin is unique.
    """
    # The tie is written with the pieces: it tells equal rows apart and stays when a task is run again.
    tie = F.xxhash64(F.monotonically_increasing_id(), "start", "ids_crc32")
    cut = materialize(pieces(docs, vocabulary, room, end_id, id_col, text_col).withColumnRenamed(id_col, "id").withColumn("tie", tie))
    groups = max(1, -(-cut.count() // group_pieces))
    id_type = cut.schema["id"].dataType.simpleString()

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["tie", "start"], kind="stable", ignore_index=True)
        bins, offsets = first_fit_decreasing(frame["length"].to_numpy(), room)
        frame["sequence_id"] = (int(key[0]) << 32) + bins
        frame["offset"] = offsets
        return frame[["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    dealt = cut.withColumn("pack_group", F.pmod("tie", F.lit(groups)))
    packed = dealt.groupBy("pack_group").applyInPandas(run, f"id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return packed.withColumnRenamed("id", id_col)
