"""Vectorised work on the UTF-8 bytes of many texts at once.

A batch of texts is one byte array with offsets. Words, lines and windows become arrays of positions. A byte
range's identity is two 64-bit lanes: a range of up to 15 bytes is held in them as it is, so that equal lanes are
equal bytes; a longer one is held by 120 bits of its BLAKE2b digest. The lanes are mixed into one 64-bit key for
sorting and searching; where a wrong match of keys would spoil a result, the lanes are compared as well.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
BIG = np.iinfo(np.int64).max

#: Bytes that two lanes hold as they are.
SHORT = 15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
_FILL = np.array([(1 << 8 * n) - 1 for n in range(8)] + [2**64 - 1], np.uint64)

#: The separators of words: space and the bytes 0x09 to 0x0D.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Hand freed memory back to the system: a worker stays for the tasks of other operators."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def texts_of(column: pa.Array) -> pa.Array:
    """The column as strings without nulls (null: empty text)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.string()), "")


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of stretches of rows of about limit bytes; a longer text stands alone.

    Memory freed meanwhile goes back to the system at the end.
    """
    n = len(texts)
    if not n:
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
    release()


def lower(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return _LOWER[data]


def lanes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The identity [range, 2] of each byte range; the last byte tells the length of a short one and is 255 for a digest."""
    size = ends - starts
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    loads = np.ndarray(len(data) + 9, np.uint64, padded, strides=(1,))  # eight bytes from every place on
    out = np.empty((len(starts), 2), np.uint64)
    out[:, 0] = loads[starts] & _FILL[np.minimum(size, 8)]
    out[:, 1] = size.astype(np.uint64) << np.uint64(56)
    more = np.flatnonzero(size > 8)
    out[more, 1] |= loads[starts[more] + 8] & _FILL[np.minimum(size[more] - 8, 7)]
    long = np.flatnonzero(size > SHORT)
    if len(long):
        raw = memoryview(np.ascontiguousarray(data))
        digests = b"".join(hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(starts[long].tolist(), ends[long].tolist()))
        out[long] = np.frombuffer(digests, np.uint64).reshape(-1, 2)
        out[long, 1] |= np.uint64(255 << 56)
    return out


def key(identity: np.ndarray) -> np.ndarray:
    """One 64-bit number of each pair of lanes, for sorting and searching."""
    return mix(mix(identity[:, 0] + _ODD) * _ODD ^ mix(identity[:, 1]))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit keys of byte ranges: for counts inside one text and for sets of shingles, where a chance match in 2^64 is harmless."""
    return key(lanes(data, starts, ends))


class Lists:
    """Lists of numbers, added at the end and read by their places."""

    def __init__(self, kind: type):
        self.flat, self.used, self.begin, self.size, self.n = np.zeros(1 << 16, kind), 0, np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def __len__(self) -> int:
        return self.n

    def add(self, flat: np.ndarray, size: np.ndarray) -> None:
        """Lists of the given sizes, one after another in flat."""
        self.flat = _roomy(self.flat, self.used + len(flat))
        self.begin, self.size = _roomy(self.begin, self.n + len(size)), _roomy(self.size, self.n + len(size))
        self.flat[self.used : self.used + len(flat)] = flat
        self.begin[self.n : self.n + len(size)] = self.used + np.cumsum(size) - size
        self.size[self.n : self.n + len(size)] = size
        self.used, self.n = self.used + len(flat), self.n + len(size)

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists at the given places one after another, and where each begins (one more at the end)."""
        size = self.size[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        return self.flat[np.arange(ends[-1]) + np.repeat(self.begin[at] - ends[:-1], size)], ends


def _roomy(have: np.ndarray, need: int) -> np.ndarray:
    return have if need <= len(have) else np.concatenate([have, np.zeros(max(need - len(have), len(have)), have.dtype)])


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of inside; runs end at the ends of texts."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (edge[:n] | ~before))
    ends = np.flatnonzero(inside & (edge[1:] | ~after)) + 1
    return starts, ends


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each text the index of its first word (one more at the end)."""
    starts, ends = spans(~SEPARATOR[data], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def owners(first: np.ndarray) -> np.ndarray:
    """For each item its text, from the first item of each text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def windows(values: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each window of width items inside one text, and for each text its first window.

    Windows of 1, 2, 4 ... items are mixed from two halves, and those of width from the powers of two in it.
    """
    counts = np.maximum(np.diff(first) - (width - 1), 0)
    begins = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(begins[-1]) - np.repeat(begins[:-1], counts) + np.repeat(first[:-1], counts)
    out, done, size, power = None, 0, 1, values
    while size <= width:
        if width & size:
            part = power[at + done] if len(at) else np.zeros(0, np.uint64)
            out = part if out is None else mix(out * _ODD + part)
            done += size
        power = mix(power[:-size] * _ODD + power[size:])
        size *= 2
    return mix(out + np.uint64(width)), begins


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values over each text's range."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def flag_counts(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return sums(flags.view(np.int8) if flags.dtype == bool else flags, offsets)


def sort_within(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The values sorted inside each text's range."""
    out = values.copy()
    for i in np.flatnonzero(np.diff(offsets) > 1).tolist():
        out[offsets[i] : offsets[i + 1]].sort()
    return out


def repeated(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Flags of the values that occur twice or more in their text."""
    own = mix(values + mix(owner.astype(np.uint64)))
    ordered = np.sort(own)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(own), bool)
    i = np.minimum(np.searchsorted(twice, own), len(twice) - 1)
    return twice[i] == own
