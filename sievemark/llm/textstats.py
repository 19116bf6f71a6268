"""Statistics of whole texts, for rules, labellers and trees."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ragged

REPEAT_WORDS = 8

#: The symbol characters that the base rules count.
SYMBOLS = "#*$%&|<>"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_digits", "n_bangs", "n_pipes", "n_ends", "n_distinct_words", "n_top_word", "n_same_next", "n_symbol_words"]


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_IS_SYMBOL, _IS_UPPER, _IS_LOWER, _IS_DIGIT = _table(SYMBOLS), _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("abcdefghijklmnopqrstuvwxyz"), _table("0123456789")
_IS_BANG, _IS_PIPE, _IS_END = _table("!"), _table("|"), _table(".!?")
#: Plain letters beside the first byte of a two-byte code point: letters in the Latin, Greek and Cyrillic blocks, mostly.
_IS_LOWER[0xC3:0xD5] = True


def text_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS of each text."""
    starts, ends, first = ragged.words(data, offsets)
    values = ragged.hashes(data, starts, ends)
    owner = ragged.owners(first)
    out = {"n_words": np.diff(first)}
    out["word_chars"] = ragged.flag_counts(((data & 0xC0) != 0x80) & ~ragged.SEPARATOR[data], offsets)
    for name, table in (("n_symbols", _IS_SYMBOL), ("n_upper", _IS_UPPER), ("n_lower", _IS_LOWER), ("n_digits", _IS_DIGIT), ("n_bangs", _IS_BANG), ("n_pipes", _IS_PIPE), ("n_ends", _IS_END)):
        out[name] = ragged.flag_counts(table[data], offsets)

    line_starts, line_ends = _lines(data, offsets)
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[worded], line_ends[worded]
    first_line = np.searchsorted(line_starts, offsets)
    line_owner = ragged.owners(first_line)
    own = ragged.mix(ragged.hashes(data, line_starts, line_ends) + ragged.mix(line_owner.astype(np.uint64)))
    distinct = np.unique(own, return_index=True)[1]
    again = np.ones(len(own), bool)
    again[distinct] = False
    out["n_lines"] = np.diff(first_line)
    out["n_dup_lines"] = np.bincount(line_owner[again], minlength=len(offsets) - 1)

    seen, begins = ragged.windows(values, first, REPEAT_WORDS)
    window_owner = ragged.owners(begins)
    at = np.arange(len(seen)) - begins[:-1][window_owner] + first[:-1][window_owner]
    at = at[ragged.repeated(seen, window_owner)]
    covered = np.zeros(len(starts) + 1, np.int32)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + REPEAT_WORDS, -1)
    out["n_repeat_words"] = ragged.flag_counts(np.cumsum(covered)[:-1] > 0, first)

    ordered = ragged.sort_within(values, first)
    fresh = np.ones(len(ordered), bool)
    fresh[1:] = (ordered[1:] != ordered[:-1]) | (owner[1:] != owner[:-1])
    heads = np.flatnonzero(fresh)
    runs = np.diff(np.append(heads, len(ordered)))
    first_run = np.searchsorted(heads, first)
    out["n_distinct_words"] = np.diff(first_run)
    top = np.zeros(len(first) - 1, np.int64)
    full = np.flatnonzero(np.diff(first_run))
    if len(full):
        top[full] = np.maximum.reduceat(runs, first_run[full])
    out["n_top_word"] = top
    same = np.zeros(len(values), bool)
    same[1:] = (values[1:] == values[:-1]) & (owner[1:] == owner[:-1])
    out["n_same_next"] = ragged.flag_counts(same, first)
    tail = _IS_SYMBOL[data[ends - 1]] if len(ends) else np.zeros(0, bool)
    out["n_symbol_words"] = ragged.flag_counts(tail, first)
    return {c: out[c].astype(np.int64) for c in COUNTS}


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    breaks = np.flatnonzero(data == 10)
    starts = np.union1d(breaks + 1, offsets[:-1][np.diff(offsets) > 0])
    starts = starts[starts < len(data)]
    behind = np.append(breaks, len(data))[np.searchsorted(breaks, starts)]
    return starts, np.minimum(behind, offsets[np.searchsorted(offsets, starts, "right")])


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    """One row per text: see FEATURES."""
    c = {k: v.astype(np.float64) for k, v in counts.items()}
    words, chars, lines = (np.maximum(c[k], 1) for k in ("n_words", "word_chars", "n_lines"))
    letters = np.maximum(c["n_upper"] + c["n_lower"], 1)
    return np.column_stack([
        np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / chars, c["n_symbol_words"] / words, c["n_upper"] / letters, c["n_digits"] / chars,
        c["n_bangs"] / words, c["n_pipes"] / words, c["n_ends"] / words, c["n_dup_lines"] / lines, c["n_repeat_words"] / words,
        c["n_distinct_words"] / words, c["n_top_word"] / words, c["n_same_next"] / words,
    ])


FEATURES = ["log_words", "word_length", "symbol_share", "symbol_word_share", "upper_share", "digit_share", "bang_rate", "pipe_rate", "end_rate", "dup_line_share", "repeat_share", "distinct_share", "top_word_share", "same_next_share"]


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and COUNTS of every row (null text: empty)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = ragged.texts_of(b.column(1))
            for lo, hi, data, offsets in ragged.slices(texts):
                found = text_counts(data, offsets)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *(pa.array(found[c]) for c in COUNTS)], ["id", *COUNTS])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {id_type}, " + ", ".join(f"{c} long" for c in COUNTS))
    return out.withColumnRenamed("id", id_col)
