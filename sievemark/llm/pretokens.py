"""Pre-tokens of byte-level BPE, found for many texts at once from code point classes.

The rule is that of the public pattern (contractions, then an optional space before a run of letters, of
numbers or of other signs, then white space): runs of one class are cut, and the last plain space of a white
space run joins the run behind it.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np

from . import ragged

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3

#: Unicode's White_Space code points.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def classes() -> np.ndarray:
    first = np.array([ord(unicodedata.category(chr(c))[0]) for c in range(sys.maxunicode + 1)], np.uint8)
    out = np.zeros(len(first), np.uint8)
    out[first == ord("L")] = LETTER
    out[first == ord("N")] = NUMBER
    out[WHITE_SPACE] = SPACE
    return out


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where pre-tokens start, and for each text the index of its first pre-token (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    n = len(points)
    edge = np.zeros(n + 1, bool)
    edge[np.searchsorted(at, offsets)] = True
    kind = classes()[points]
    start = edge[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    heads = np.flatnonzero(start)
    tails = np.append(heads[1:], n)
    white = (kind[heads] == SPACE) & ~edge[tails]
    last, behind, wide = tails[white] - 1, tails[white], (tails - heads)[white] > 1
    plain = points[last] == 32
    start[last[plain | wide]] = True
    start[behind[plain]] = False
    lone = heads[(tails - heads == 1) & (points[heads] == 39)]
    lone = lone[start[lone] & ~edge[lone + 1]]
    if len(lone):
        padded = np.append(points, [0, 0])
        one, two = padded[lone + 1], np.where(edge[np.minimum(lone + 2, n)], 0, padded[lone + 2])
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
        for a, b in ("re", "ve", "ll"):
            size = np.where((one == ord(a)) & (two == ord(b)), 2, size)
        lone, size = lone[size > 0], size[size > 0]
        start[lone + 1] = False
        then = lone + 1 + size
        start[then[then < n]] = True
    starts = at[np.flatnonzero(start)]
    return starts, np.searchsorted(starts, offsets)


class Names:
    """Keys of pieces with the lanes that tell two pieces of one key apart."""

    def __init__(self, keys: np.ndarray, lanes: np.ndarray):
        self.keys, self.lanes = keys, lanes

    def __len__(self) -> int:
        return len(self.keys)

    def __getitem__(self, at: np.ndarray) -> Names:
        return Names(self.keys[at], self.lanes[at])


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray | None = None) -> tuple[Names, np.ndarray, np.ndarray, np.ndarray]:
    """Names of the distinct pieces (by key), an example's start and end of each, and for each piece its index there."""
    ends = np.append(starts[1:], len(data)) if ends is None else ends
    lanes = ragged.lanes(data, starts, ends)
    keys = ragged.key(lanes)
    _, first, back = np.unique(keys, return_index=True, return_inverse=True)
    if not np.array_equal(lanes[first].take(back, 0), lanes):  # two pieces of one key: number the pairs of lanes themselves
        order = np.lexsort((lanes[:, 0], lanes[:, 1], keys))
        fresh = np.append(True, (lanes[order[1:]] != lanes[order[:-1]]).any(1))
        first, back = order[fresh], np.empty(len(order), np.int64)
        back[order] = np.cumsum(fresh) - 1
    return Names(keys[first], lanes[first]), starts[first], ends[first], back


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the pieces one after another, and the piece of each byte."""
    size = ends - starts
    piece = np.repeat(np.arange(len(size)), size)
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else starts, size)
    return data[np.arange(len(piece)) + shift], piece


class Known:
    """Values of distinct pieces, kept between batches of a worker and emptied beyond a bound.

    The names lie in runs sorted by key; a run is merged into the one before it once it is half as long, so that adding
    stays cheap. Of two pieces of one key at most one is found; the other counts as unknown.
    """

    def __init__(self, most: int = 2_000_000):
        self.most, self.runs = most, []

    def __len__(self) -> int:
        return sum(len(k) for k, _ in self.runs)

    def find(self, names: Names) -> tuple[np.ndarray, np.ndarray]:
        """Values, and which names are known."""
        values, have = np.zeros(len(names), np.int64), np.zeros(len(names), bool)
        for known, kept in self.runs:
            i = np.minimum(np.searchsorted(known.keys, names.keys), len(known) - 1)
            hit = np.flatnonzero(known.keys[i] == names.keys)
            was, now = known.lanes[i[hit]], names.lanes[hit]
            hit = hit[(was[:, 0] == now[:, 0]) & (was[:, 1] == now[:, 1])]
            values[hit] = kept[i[hit]]
            have[hit] = True
        return values, have

    def add(self, names: Names, values: np.ndarray) -> None:
        """Add new names, sorted by key."""
        if len(self) + len(names) > self.most:
            self.runs = []
        if not len(names):
            return
        self.runs.append((names, values))
        while len(self.runs) > 1 and 2 * len(self.runs[-1][0]) >= len(self.runs[-2][0]):
            (n1, v1), (n2, v2) = self.runs[-2:]
            order = np.argsort(np.concatenate([n1.keys, n2.keys]), kind="stable")
            joined = Names(np.concatenate([n1.keys, n2.keys]), np.concatenate([n1.lanes, n2.lanes]))
            self.runs[-2:] = [(joined[order], np.concatenate([v1, v2])[order])]
