"""Language identification by unigrams over pieces of a fixed vocabulary, summed over all segmentations.

Each language has a probability for every piece of a public vocabulary. A word's probability is the sum over all
ways to cut it into pieces, by a forward algorithm that steps through all distinct words of a batch at once; a
text's is the product over its words. Pieces are found
in a tree of their signs, sign by sign, at all places at once. The piece probabilities come from a bounded sample of labelled texts by
expectation-maximisation (forward and backward sums give each piece's expected count).
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pretokens, ragged
from .common import materialize

#: About so many training texts of each language at most, chosen by the hash of the id; rounds of expectation-maximisation.
TRAIN_ROWS, ROUNDS = 1_200, 3
#: Longest piece in code points; longest word that is scored side by side with others (longer ones are stepped through alone, and training
#: takes them in parts); and the probability of an unknown sign.
PIECE_CHARS, WORD_CHARS, UNKNOWN = 16, 32, 1e-8
#: Words whose agreement makes a prediction certain: the score is the posterior of a text of so many words at most.
SCORE_WORDS = 12
#: Most languages of one model (its size is pieces x languages); more are refused.
MOST_LANGS = 2_000
#: Words whose probabilities a worker keeps between batches, and words scored at once.
KEPT_WORDS, LATTICE_WORDS = 500_000, 20_000

BEGIN = 0x2581


class Pieces:
    """A vocabulary's distinct lower-cased letter pieces, and the tree of their signs.

    keys: node * 2^21 + code point of each edge, sorted; child: the node it leads to; number: a node's piece, or -1.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
        self.names = sorted(p for p in found if len(p) <= PIECE_CHARS and p.lstrip(chr(BEGIN)).isalpha()) + [chr(BEGIN)]
        edges: dict[int, int] = {}
        ends = {}
        for i, name in enumerate(self.names):
            node = 0
            for c in name:
                node = edges.setdefault((node << 21) + ord(c), len(edges) + 1)
            ends[node] = i
        self.number = np.full(len(edges) + 1, -1)
        self.number[list(ends)] = list(ends.values())
        self.keys, child = np.array(list(edges)), np.array(list(edges.values()))
        order = np.argsort(self.keys)
        self.keys, self.child = self.keys[order], child[order]

    def step(self, node: np.ndarray, points: np.ndarray) -> np.ndarray:
        """The node that each sign leads to from each node, or -1."""
        key = (node << 21) + points
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[i] == key, self.child[i], -1)


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def n_pieces(path: str) -> int:
    return len(pieces(path).names)


class Lattice:
    """Pieces at every place of a batch of words (begin sign included), words sorted by falling length."""

    def __init__(self, words: list[str], path: str):
        self.order = np.array(sorted(range(len(words)), key=lambda i: -len(words[i])), np.int64)
        marked = [chr(BEGIN) + words[i] for i in self.order]
        self.size = np.array([len(w) for w in marked], np.int64)
        points = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.int64)
        begin = np.cumsum(self.size) - self.size
        left = np.repeat(begin + self.size, self.size) - np.arange(len(points))  # signs from each place to its word's end
        tree, start = pieces(path), np.arange(len(points))
        node, found = np.zeros(len(points), np.int64), []
        for length in range(1, PIECE_CHARS + 1):
            node = tree.step(node, points[start + length - 1])
            start, node = start[node >= 0], node[node >= 0]
            at = np.full(len(points), -1)
            at[start] = tree.number[node]
            found.append(at)
            start, node = start[left[start] > length], node[left[start] > length]
        self.most = int(self.size.max(initial=0))
        self.steps: dict[tuple[int, int], np.ndarray] = {}
        for end in range(1, self.most + 1):
            n = int(np.searchsorted(-self.size, -end, "right"))
            for length in range(1, min(end, PIECE_CHARS) + 1):
                at = found[length - 1][begin[:n] + end - length]
                if length == 1 or (at >= 0).any():
                    self.steps[end, length] = at

    def forward(self, p: np.ndarray) -> np.ndarray:
        """Probabilities [place, word, language] of all ways to reach a place. p: [piece (the last: unknown), language]."""
        a = np.zeros((self.most + 1, len(self.size), p.shape[1]))
        a[0] = 1
        for (end, length), at in self.steps.items():
            a[end, : len(at)] += a[end - length, : len(at)] * self._of(p, at, length)
        return a

    def _of(self, p: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
        return p[at] if length == 1 else np.where((at >= 0)[:, None], p[at], 0.0)

    def words(self, p: np.ndarray) -> np.ndarray:
        """Log probability of each word as given [word, language]."""
        a = self.forward(p)
        out = np.zeros((len(self.size), p.shape[1]))
        if len(out):
            out[self.order] = np.log(np.maximum(a[self.size, np.arange(len(self.size))], 1e-300))
        return out

    def expected(self, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected counts of each piece by language, over words weighted by weight [word, language]."""
        a = self.forward(p)
        b = np.zeros_like(a)
        rows = np.arange(len(self.size))
        b[self.size, rows] = 1
        for (end, length), at in reversed(self.steps.items()):
            b[end - length, : len(at)] += b[end, : len(at)] * self._of(p, at, length)
        share = weight[self.order] / np.maximum(a[self.size, rows], 1e-300)
        out = np.zeros_like(p)
        for (end, length), at in self.steps.items():
            n = len(at)
            gain = a[end - length, :n] * self._of(p, at, length) * b[end, :n] * share[:n]
            for k in range(p.shape[1]):
                out[:, k] += np.bincount(at % len(p), gain[:, k], len(p))
        return out


#: Places of a long word whose pieces are looked up at once.
_BLOCK = 1 << 16


def long_word(word: str, p: np.ndarray, path: str) -> np.ndarray:
    """Log probability [language] of a word of any length: the forward sums of the last PIECE_CHARS places go with it, and are scaled before they vanish."""
    points = np.frombuffer((chr(BEGIN) + word).encode("utf-32-le"), np.uint32).astype(np.int64)
    tree, logs, sums = pieces(path), np.zeros(p.shape[1]), np.zeros((PIECE_CHARS, p.shape[1]))
    sums[0] = 1  # sums[j]: of all ways to come to the place j signs before the last one
    for low in range(0, len(points), _BLOCK):
        high = min(low + _BLOCK, len(points))
        found = np.full((high - low + 1, PIECE_CHARS), -1)  # [end of a piece, its length less 1]
        start = np.arange(max(0, low - PIECE_CHARS + 1), high)
        node = np.zeros(len(start), np.int64)
        for length in range(1, PIECE_CHARS + 1):
            node = tree.step(node, points[start + length - 1])
            start, node = start[node >= 0], node[node >= 0]
            inside = start + length > low
            found[start[inside] + length - low, length - 1] = tree.number[node[inside]]
            more = start + length < high
            start, node = start[more], node[more]
        for at in found[1:]:
            gain = p[at]
            gain[1:][at[1:] < 0] = 0
            now = (sums * gain).sum(0)
            sums[1:] = sums[:-1]
            sums[0] = now
            if now.min() < 1e-30:
                logs += np.log(now)
                sums /= now
    return logs + np.log(sums[0])


def letter_parts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int | None = WORD_CHARS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct lower-cased words of letters, in parts of most signs (None: whole); for each part of a piece its word and its piece."""
    raw = data.tobytes()
    texts = [raw[a:b].decode().strip().lower().lstrip("'") for a, b in zip(starts.tolist(), ends.tolist())]
    cut = lambda w: [w] if most is None else [w[i : i + most] for i in range(0, len(w), most)]
    parts = [cut(w) if w.isalpha() else [] for w in texts]
    places: dict[str, int] = {}
    flat = np.array([places.setdefault(x, len(places)) for p in parts for x in p], np.int64)
    return list(places), flat, np.repeat(np.arange(len(parts)), np.array([len(p) for p in parts], np.int64))


def letter_words(data: np.ndarray, offsets: np.ndarray, most: int | None = WORD_CHARS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """As letter_parts of all pre-tokens: distinct words, and for each occurrence its word and its text."""
    starts, first = pretokens.cut(data, offsets)
    names, s, e, back = pretokens.distinct(data, starts)
    words, flat, piece = letter_parts(data, s, e, most)
    size = np.bincount(piece, minlength=len(names))
    begin = np.cumsum(size) - size
    n = size[back]
    word = flat[np.repeat(begin[back] - (np.cumsum(n) - n), n) + np.arange(n.sum())] if n.sum() else flat[:0]
    return words, word, np.repeat(ragged.owners(first), n)


class Scorer:
    """Log probabilities of texts under each language; those of words met before are kept."""

    def __init__(self, p: np.ndarray, path: str):
        self.p, self.path = p, path
        self.forget()

    def forget(self) -> None:
        self.known = pretokens.Known(1 << 40)
        self.logs, self.parts = np.zeros((0, self.p.shape[1])), np.zeros(0, np.int64)

    def _add(self, data: np.ndarray, names: pretokens.Names, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Score new words; their places in self.logs and self.parts."""
        words, flat, piece = letter_parts(data, starts, ends, None)
        short, long = ([i for i, w in enumerate(words) if (len(w) > WORD_CHARS) == far] for far in (False, True))
        logs = np.zeros((len(words), self.p.shape[1]))
        for i in range(0, len(short), LATTICE_WORDS):
            logs[short[i : i + LATTICE_WORDS]] = Lattice([words[j] for j in short[i : i + LATTICE_WORDS]], self.path).words(self.p)
        for i in long:
            logs[i] = long_word(words[i], self.p, self.path)
        own = np.column_stack([np.bincount(piece, logs[flat, k], len(names)) for k in range(self.p.shape[1])])
        at = len(self.logs) + np.arange(len(names))
        self.known.add(names, at)
        self.logs, self.parts = np.vstack([self.logs, own]), np.append(self.parts, np.bincount(piece, minlength=len(names)))
        return at

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums [text, language] over each text's words, and the number of its words."""
        starts, first = pretokens.cut(data, offsets)
        names, s, e, back = pretokens.distinct(data, starts)
        if len(self.logs) + len(names) > KEPT_WORDS:
            self.forget()
        at, have = self.known.find(names)
        new = np.flatnonzero(~have)
        if len(new):
            at[new] = self._add(data, names[new], s[new], e[new])
        n, owner = len(offsets) - 1, ragged.owners(first)
        total = np.column_stack([np.bincount(owner, self.logs[at, k][back], n) for k in range(self.p.shape[1])])
        return total, ragged.sums(self.parts[at][back], first)


_scorers: dict[tuple, Scorer] = {}


def scorer(p: np.ndarray, path: str) -> Scorer:
    """The worker's scorer of these probabilities; only the last one is kept."""
    key = (path, p.shape, hashlib.sha256(p.tobytes()).digest())
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(p.astype(np.float64), path)
    return _scorers[key]


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    if not len(data):
        return np.zeros(len(offsets) - 1, bool)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    bounds = np.searchsorted(np.flatnonzero((data & 0xC0) != 0x80), offsets)
    return ragged.flag_counts(pretokens.classes()[points] == pretokens.LETTER, bounds) > 0


def share_of(rows: int, train_rows: int) -> float:
    """The share of a language's rows that gives train_rows of them."""
    return min(1.0, train_rows / rows)


def chance(doc_id: Column) -> Column:
    """A number from 0 to 1 (exclusive) by the id's hash, in steps of 2^-53."""
    return F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(3)), 11) / F.lit(2.0**53)


def learn(docs: DataFrame, vocabulary: str, train_rows: int = TRAIN_ROWS, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages and piece probabilities [piece, language] from docs (doc_id, text, lang), all of them labelled.

    About train_rows texts of each language are used at most, chosen by the hash of their ids, whole. The texts
    stay in the cluster; only expected counts (pieces x languages) come back each round.
    """
    found = docs.groupBy("lang").count().limit(MOST_LANGS + 1).collect()  # one row a language
    if len(found) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages: piece probabilities of all of them have no place in a task")
    counts = {r["lang"]: r["count"] for r in found}
    langs = sorted(counts)
    if not langs:
        return [], np.zeros((0, 0))
    share = F.element_at(F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, share_of(n, train_rows)))), F.col("lang"))
    sample = docs.filter(chance(F.col("doc_id")) < share).select("lang", F.col("text").cast("string").alias("text"))

    def count(batches):
        for b in batches:
            texts, names = ragged.texts_of(b.column(1)), b.column(0).to_pylist()
            for lo, hi, data, offsets in ragged.slices(texts):
                words, word, owner = letter_words(data, offsets)
                lang = np.array([langs.index(x) for x in names[lo:hi]], np.int64)[owner]
                pair, n = np.unique(word * len(langs) + lang, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in (pair // len(langs)).tolist()], pa.string()), pa.array((pair % len(langs)).astype(np.int32)), pa.array(n)], ["word", "lang", "n"])

    counted = sample.mapInArrow(count, "word string, lang int, n long")
    spread = docs.sparkSession.sparkContext.defaultParallelism  # the bounded sample's words, as even shares of every round
    table = materialize(counted.repartition(spread, "word").groupBy("word", "lang").agg(F.sum("n").alias("n")))
    size = n_pieces(vocabulary)
    p = np.full((size + 1, len(langs)), 1.0 / size)
    p[-1] = UNKNOWN

    def expect(batches):
        total = np.zeros_like(p)
        for b in batches:
            words, back = np.unique(np.array(b.column(0).to_pylist(), object), return_inverse=True)
            weight = np.zeros((len(words), len(langs)))
            np.add.at(weight, (back, b.column(1).to_numpy()), b.column(2).to_numpy())
            for i in range(0, len(words), 20_000):
                total += Lattice(words[i : i + 20_000].tolist(), vocabulary).expected(p, weight[i : i + 20_000])
        at, lang = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(lang.astype(np.int32)), pa.array(total[at, lang])], ["piece", "lang", "n"])

    for _ in range(rounds):
        found = table.mapInArrow(expect, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()  # at most pieces x languages rows
        n = np.zeros_like(p)
        n[found["piece"].to_numpy(), found["lang"].to_numpy()] = found["n"].to_numpy()
        n = n[:-1] + 0.02
        p = np.vstack([n / n.sum(0), np.full((1, len(langs)), UNKNOWN)])
    return langs, p


def predict(docs: DataFrame, langs: list[str], p: np.ndarray, vocabulary: str) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, lang_pred, score."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = np.array([*langs, "und"], object)
    spark = docs.sparkSession
    given = spark.sparkContext.broadcast(p.astype(np.float32))  # pieces x languages

    def run(batches):
        score_of = scorer(given.value, vocabulary) if langs else None
        for b in batches:
            texts = ragged.texts_of(b.column(1))
            for lo, hi, data, offsets in ragged.slices(texts):
                n = hi - lo
                best, score = np.full(n, len(langs)), np.zeros(n)
                if langs and len(data):
                    total, seen = score_of(data, offsets)
                    spread = (total - total.max(1, keepdims=True)) * np.minimum(1, SCORE_WORDS / np.maximum(seen, 1))[:, None]
                    post = np.exp(spread) / np.exp(spread).sum(1, keepdims=True)
                    some = has_letter(data, offsets)
                    best = np.where(some, total.argmax(1), len(langs))
                    score = np.where(some, post.max(1), 0.0)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, n), pa.array(names[best].tolist(), pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double")


def identify(docs: DataFrame, vocabulary: str, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Per row of docs (doc_id, text, lang): doc_id, held_out, lang_pred, score (0 to 1).

    Rows whose crc32(doc_id as text) mod 3 is 1 are held out; the piece probabilities are learnt from texts of the
    others with a lang. A null text, or one without a letter, is 'und' with score 0, as is every text if there is
    nothing to learn from. A null doc_id isn't held out and isn't learnt from. Repeated rows give a row each,
    other columns are left out, an empty table gives an empty result. Ties go to the language first in order.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    langs, p = learn(docs.filter((fold != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang"), vocabulary, train_rows)
    found = predict(docs, langs, p, vocabulary)
    return found.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
