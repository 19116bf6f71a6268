"""Byte-level BPE encoding and decoding with recursive SQL inside each partition.

Spark partitions the texts; in each task the distinct pre-tokens of a batch go to an in-process DuckDB as
token-position rows. A recursive query joins neighbouring tokens with the merge table and contracts each word's
leftmost pair of lowest rank until no pair has a rank; only the last state of each row is kept. Decoding is a query of
its own: it takes ids alone, joins them with the vocabulary and puts the bytes together by an ordered aggregation.

A long word is contracted in overlapping chunks, so that the work stays near its length. A sequence of tokens is a
word's encoding if each two neighbours are what their joined bytes are encoded to; where two chunks share a token in
their overlap, its neighbours on the left come from the one chunk and those on the right from the other, and the
chunks may be put together there. Neighbouring chunks that share no token (long runs of one sign) become one chunk.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pretokens, ragged

#: Words whose ids a worker keeps between batches, bytes of words handed to one recursive query, and ids to one decoding query.
KEPT_WORDS = 600_000
QUERY_BYTES, DECODE_IDS = 400_000, 500_000

#: Words of more bytes are cut into chunks that begin every STEP bytes and are STEP + OVERLAP bytes long.
LONG_WORD, STEP, OVERLAP = 96, 64, 32
#: Chunks (made of many that share no token) of more bytes contract all occurrences of a pair that don't overlap at once.
WIDE_CHUNK = 512

#: A row holds a token and its right neighbour. A step finds each word's pair of lowest rank (the leftmost of equal
#: ones), drops its left row, gives its right row the merged token and tells the row before it; a merged token's id is the rank.
#: All rows of a word still at work are written anew, over the ones of the step before; those of its highest step are its tokens.
PAIR_BY_PAIR = """
WITH RECURSIVE state(w, pos, step, tok, nxt) USING KEY (w, pos) AS (
    SELECT w, pos, 0, tok, nxt FROM word_rows
    UNION ALL
    SELECT w, CASE WHEN pos > place THEN pos - 1 ELSE pos END, step + 1, CASE WHEN pos = place + 1 THEN merged ELSE tok END, CASE WHEN pos = place - 1 THEN merged ELSE nxt END
    FROM state JOIN (
        SELECT w, CAST(best % 65536 AS INTEGER) AS place, CAST(best // 65536 AS INTEGER) AS merged
        FROM (SELECT w, min(CAST(m.rank AS BIGINT) * 65536 + pos) AS best FROM state JOIN merges m ON m.a = tok AND m.b = nxt GROUP BY w)
    ) USING (w)
    WHERE pos <> place
), """

#: The same for words of any length: a step takes all occurrences of the lowest pair, every second one of a run of overlapping ones.
PAIRS_AT_ONCE = """
WITH RECURSIVE state(w, pos, step, tok) USING KEY (w, pos) AS (
    SELECT w, pos, 0, tok FROM word_rows
    UNION ALL
    SELECT w, pos, step + 1, CASE WHEN chosen THEN merged ELSE tok END
    FROM (
        SELECT *, lag(chosen, 1, false) OVER (PARTITION BY w ORDER BY pos) AS swallowed
        FROM (
            SELECT *, hit AND (row_number() OVER (PARTITION BY w, island ORDER BY pos)) % 2 = CASE WHEN starts THEN 1 ELSE 0 END AS chosen
            FROM (
                SELECT *, first_value(hit) OVER (PARTITION BY w, island ORDER BY pos) AS starts
                FROM (
                    SELECT *, count(*) FILTER (NOT hit) OVER (PARTITION BY w ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island
                    FROM (
                        SELECT *, coalesce(rank = low, false) AS hit
                        FROM (
                            SELECT s.step, s.w, s.pos, s.tok, m.rank, m.merged, min(m.rank) OVER (PARTITION BY s.w) AS low
                            FROM (SELECT *, lead(tok) OVER (PARTITION BY w ORDER BY pos) AS nxt FROM state) s
                            LEFT JOIN merges m ON m.a = s.tok AND m.b = s.nxt
                        )
                        WHERE low IS NOT NULL
                    )
                )
            )
        )
    )
    WHERE NOT swallowed
), """

IDS = """
last AS (SELECT w, max(step) AS step FROM state GROUP BY w)
SELECT w, tok FROM state JOIN last USING (w, step) ORDER BY w, pos
"""

DECODE = """
SELECT text, block, string_agg(v.bytes, '' ORDER BY pos) AS bytes
FROM id_rows JOIN vocabulary v USING (id) GROUP BY text, block ORDER BY text, block
"""


class Codec:
    """A vocabulary's merge table in DuckDB, and the words encoded lately."""

    def __init__(self, path: str):
        import duckdb

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        rows = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        a, b, r = (pa.array(x, pa.int32()) for x in zip(*rows))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "350MB", "temp_directory": ""})
        merges = pa.table({"a": a, "b": b, "rank": r, "merged": r})
        vocabulary = pa.table({"id": pa.array(ranks.values(), pa.int32()), "bytes": pa.array([t.hex() for t in ranks])})
        for name, table in (("merges", merges), ("vocabulary", vocabulary)):
            self.db.register("given", table)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        self.size, self.decimal = np.zeros(max(ranks.values()) + 1, np.int64), np.empty(max(ranks.values()) + 1, object)
        for t, r in ranks.items():
            self.size[r], self.decimal[r] = len(t), str(r).encode()
        self.forget()

    def forget(self) -> None:
        self.known, self.kept = pretokens.Known(1 << 40), ragged.Lists(np.int32)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and where each text's begin (one more at the end)."""
        starts, first = pretokens.cut(data, offsets)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        names, s, e, back = pretokens.distinct(data, starts)
        if len(self.kept) + len(names) > KEPT_WORDS:
            self.forget()
        at, have = self.known.find(names)
        new = np.flatnonzero(~have)
        if len(new):
            at[new] = len(self.kept) + np.arange(len(new))
            self.kept.add(*self.words(data, s[new], e[new]))
            self.known.add(names[new], at[new])
        ids, ends = self.kept.take(at[back])
        return ids, ends[first]

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after another, and the number of each word's."""
        long = np.flatnonzero(ends - starts > LONG_WORD)
        if not len(long):
            return self._contract(data, starts, ends)
        short = np.flatnonzero(ends - starts <= LONG_WORD)
        found = ragged.Lists(np.int32)
        found.add(*self._contract(data, starts[short], ends[short]))
        found.add(*self._long(data, starts[long], ends[long]))
        order = np.argsort(np.concatenate([short, long]), kind="stable")
        ids, bounds = found.take(order)
        return ids, np.diff(bounds)

    def _long(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of long words one after another, and the number of each word's, from chunks that share a token with the next one."""
        n = np.maximum(1, -(-(ends - starts - OVERLAP) // STEP))
        word = np.repeat(np.arange(len(starts)), n)
        begin = starts[word] + STEP * (np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n))
        known: dict[tuple[int, int], np.ndarray] = {}
        while True:
            inner = word[1:] == word[:-1]  # whether a chunk has another one of its word behind it
            end = ends[word]
            end[:-1] = np.where(inner, np.minimum(begin[1:] + OVERLAP, end[:-1]), end[:-1])
            spans = list(zip(begin.tolist(), end.tolist()))
            todo = np.array([s for s in spans if s not in known], np.int64).reshape(-1, 2)
            wide = todo[:, 1] - todo[:, 0] > WIDE_CHUNK
            for part, query in ((todo[~wide], PAIR_BY_PAIR), (todo[wide], PAIRS_AT_ONCE)):
                if len(part):
                    ids, size = self._contract(data, part[:, 0], part[:, 1], query)
                    known |= dict(zip(map(tuple, part.tolist()), np.split(ids, np.cumsum(size)[:-1])))
            ids = np.concatenate([known[s] for s in spans])
            chunk = np.repeat(np.arange(len(spans)), [len(known[s]) for s in spans])
            head = np.searchsorted(chunk, np.arange(len(spans) + 1))
            size = self.size[ids]
            place = np.cumsum(size) - size
            place += (begin - place[head[:-1]])[chunk]
            # Tokens in a chunk's tail and in the next one's front, by place and size; the first that two chunks share joins them.
            tail = np.flatnonzero(place >= np.append(np.where(inner, begin[1:], len(data)), len(data))[chunk])
            front = np.flatnonzero(place + size <= np.append(0, np.where(inner, end[:-1], 0))[chunk])
            here = place * 256 + size
            _, i, j = np.intersect1d(here[tail], here[front], assume_unique=True, return_indices=True)
            i, j = tail[i], front[j]
            pair, once = np.unique(chunk[i], return_index=True)
            lost = np.setdiff1d(np.flatnonzero(inner), pair)
            if len(lost):
                begin, word = np.delete(begin, lost + 1), np.delete(word, lost + 1)
                continue
            first, behind = head[:-1].copy(), head[1:].copy()
            first[pair + 1], behind[pair] = j[once], i[once]
            mark = np.zeros(len(ids) + 1, np.int64)
            np.add.at(mark, first, 1)
            np.add.at(mark, behind, -1)
            taken = np.cumsum(mark)[:-1] > 0
            return ids[taken], np.bincount(word[chunk[taken]], minlength=len(starts))

    def _contract(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, query: str = PAIR_BY_PAIR) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after another, and the number of each word's, by recursive queries of about QUERY_BYTES each."""
        ids, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        share = np.cumsum(ends - starts) // QUERY_BYTES
        for k in np.unique(share):
            s, e = starts[share == k], ends[share == k]
            flat, owner = pretokens.gather(data, s, e)
            tokens = self.byte_ids[flat]
            size = e - s
            position = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
            following = np.where(np.append(owner[1:] == owner[:-1], False), np.append(tokens[1:], 0), -1)
            table = pa.table({c: pa.array(v, pa.int32()) for c, v in (("w", owner), ("pos", position), ("tok", tokens), ("nxt", following))})
            self.db.register("word_rows", table)
            w, found = (c.to_numpy() for c in self.db.sql(query + IDS).to_arrow_table().columns)
            self.db.unregister("word_rows")
            ids.append(found)
            counts.append(np.bincount(w, minlength=len(s)))
        return np.concatenate(ids), np.concatenate(counts)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The bytes of each text from its ids (those of text i from bounds[i] to bounds[i + 1]); an id without bytes is refused."""
        if len(ids) and not (0 <= ids.min() and ids.max() < len(self.size) and (self.size[ids] > 0).all()):
            raise ValueError("an id that the vocabulary doesn't have")
        out = [b""] * (len(bounds) - 1)
        text = np.repeat(np.arange(len(out)), np.diff(bounds))
        for lo in range(0, len(ids), DECODE_IDS):
            now = slice(lo, lo + DECODE_IDS)
            pos = np.arange(lo, lo + len(ids[now]))
            table = pa.table({"text": pa.array(text[now], pa.int32()), "block": pa.array(pos // DECODE_IDS), "pos": pa.array(pos), "id": pa.array(ids[now], pa.int32())})
            self.db.register("id_rows", table)
            found, _, raw = (c.to_pylist() for c in self.db.sql(DECODE).to_arrow_table().columns)
            self.db.unregister("id_rows")
            for i, x in zip(found, raw):
                out[i] += bytes.fromhex(x)
        return out


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def _given(docs: DataFrame, id_col: str, col: Column) -> tuple[DataFrame, str]:
    return docs.select(F.col(id_col).alias("id"), col.alias("given")), docs.schema[id_col].dataType.simpleString()


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, ids (array of the text's token ids).

    vocabulary: path of a rank file, readable on every executor. Null text is taken as empty: no ids. Null ids and
    repeated rows give a row each; other columns are left out; an empty table gives an empty result. Strings of
    special tokens are ordinary text. Texts are taken whole, any length.
    """

    def run(batches):
        for b in batches:
            for lo, hi, data, offsets in ragged.slices(ragged.texts_of(b.column(1))):
                ids, bounds = codec(vocabulary).encode(data, offsets)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))], ["id", "ids"])

    given, id_type = _given(docs, id_col, F.col(text_col).cast("string"))
    return given.mapInArrow(run, f"id {id_type}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id_col, decoded (binary: the bytes that the row's ids stand for, in order).

    Null or empty lists give no bytes. An id that the vocabulary doesn't have, or a null one, is an error. Null id_col and
    repeated rows give a row each; other columns are left out; an empty table gives an empty result.
    """

    def run(batches):
        for b in batches:
            lists = pc.fill_null(b.column(1), [])
            ids, bounds = lists.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
            if ids.null_count:
                raise ValueError("a null id")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codec(vocabulary).decode(ids.to_numpy(zero_copy_only=False), bounds), pa.binary())], ["id", "decoded"])

    given, id_type = _given(encoded, id_col, F.col(ids_col).cast("array<int>"))
    return given.mapInArrow(run, f"id {id_type}, decoded binary").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and then decodes the ids, as digests: id_col, n_tokens, ids_sha256 (of the decimal ids joined by spaces), decoded_sha256.

    Rows are treated as by encode(); ids don't leave the task between the two.
    """

    def run(batches):
        hexed = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            for lo, hi, data, offsets in ragged.slices(ragged.texts_of(b.column(1))):
                c = codec(vocabulary)
                ids, bounds = c.encode(data, offsets)
                written = c.decimal[ids]
                told = [hexed(b" ".join(written[x:y])) for x, y in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(np.diff(bounds)), pa.array(told, pa.string()), pa.array([hexed(x) for x in c.decode(ids, bounds)], pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    given, id_type = _given(docs, id_col, F.col(text_col).cast("string"))
    return given.mapInArrow(run, f"id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
