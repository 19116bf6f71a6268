"""Span finding and small algorithms in DataFrame expressions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Control signs that mark matches; in texts they give way to a third one, which no pattern here names.
OPEN, CLOSE, PLAIN = "\x01", "\x02", "\x03"
_BLOCK, _TEXT_BLOCK = 256, 1024

SPAN_TYPE = "array<struct<kind: string, start: int, end: int, text: string>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _before(values: Column, at: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each item of values, at and the items before it put together by op (and one more: all of them)."""
    return F.aggregate(values, F.array(at), lambda done, x: F.concat(done, F.array(op(F.element_at(done, -1), x))))


def scan(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """The integers before each item put together by op (0 at first), in blocks, so that the work stays near the number of items."""

    def of_blocks(blocks: Column) -> Column:
        whole = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), op))
        return let(_before(whole, F.lit(0), op), lambda begins: F.flatten(F.transform(blocks, lambda b, i: F.slice(_before(b, F.get(begins, i), op), 1, F.size(b)))))

    return let(values, lambda n: let(_cut(n, _BLOCK), of_blocks))


def _cut(items: Column, size: int) -> Column:
    """A filled array in stretches of size items."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / size).cast("int")), lambda i: F.slice(items, i * size + 1, F.lit(size)))


def offsets(lengths: Column) -> Column:
    """Running sums before each item."""
    return scan(lengths, lambda a, b: a + b)


def blocks(text: Column) -> Column:
    """A text in stretches of _TEXT_BLOCK code points, for piece()."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)(.{{1,{_TEXT_BLOCK}}})"), F.lit(1))


def piece(blocks: Column, start: Column, length: Column) -> Column:
    """length code points of a text from start on, from its blocks: the work doesn't grow with start."""
    begin, end = F.floor(start / _TEXT_BLOCK).cast("int"), F.floor((start + length - 1) / _TEXT_BLOCK).cast("int")
    return F.substring(F.array_join(F.slice(blocks, begin + 1, end - begin + 1), ""), start - begin * _TEXT_BLOCK + 1, length)


def apart(spans: Column, others: Column, touches: Callable[[Column, Column], Column]) -> Column:
    """The spans that touch none of the others; touches(span, other) must imply that they overlap. The others are searched by stretches."""
    reach = lambda g: F.struct(F.array_min(F.transform(g, lambda b: b["start"])).alias("low"), F.array_max(F.transform(g, lambda b: b["end"])).alias("high"), g.alias("spans"))
    free = lambda s, groups: ~F.exists(groups, lambda g: (g["low"] < s["end"]) & (s["start"] < g["high"]) & F.exists(g["spans"], lambda b: touches(s, b)))
    searched = let(F.transform(_cut(others, _BLOCK), reach), lambda groups: F.filter(spans, lambda s: free(s, groups)))
    return F.when((F.size(spans) > 0) & (F.size(others) > 0), searched).otherwise(spans)


def masked(text: Column, spans: Column, mask: str) -> Column:
    """The text with each span (ordered by start; at least one) written over by mask, overlapping ones as one."""
    ends = F.transform(spans, lambda s: s["end"])

    def of(parts: Column, done: Column) -> Column:
        ahead = lambda s, i: F.when(s["start"] >= F.get(done, i), F.concat(piece(parts, F.get(done, i), s["start"] - F.get(done, i)), F.lit(mask))).otherwise(F.lit(""))
        return F.concat(F.array_join(F.transform(spans, ahead), ""), piece(parts, F.array_max(ends), F.length(text) - F.array_max(ends)))

    return let(blocks(text), lambda parts: let(scan(ends, lambda a, b: F.greatest(a, b)), lambda done: of(parts, done)))


def clean(text: Column) -> Column:
    """The text (null: empty) with the marking signs replaced, one for one."""
    return F.translate(F.coalesce(text, F.lit("")), OPEN + CLOSE, PLAIN + PLAIN)


def find(text: Column, kind: str, pattern: str, needs: Column | None = None) -> Column:
    """All leftmost non-overlapping matches of pattern in clean text: kind, start, end (code points, end exclusive), text.

    Matches are marked by one replacement; the marked text is cut, and the lengths of its parts give the places.
    needs: a cheap condition without which there is no match.
    """
    parts = F.split(F.regexp_replace(text, F.lit(f"({pattern})"), F.lit(OPEN + "$1" + CLOSE)), f"[{OPEN}{CLOSE}]")

    def placed(p: Column) -> Column:
        numbers = F.sequence(F.lit(2), F.size(p), F.lit(2))
        found = lambda begin: F.transform(numbers, lambda i: F.struct(F.lit(kind).alias("kind"), F.element_at(begin, i).alias("start"), (F.element_at(begin, i) + F.length(F.element_at(p, i))).cast("int").alias("end"), F.element_at(p, i).alias("text")))
        return let(offsets(F.transform(p, F.length)), found)

    matches = text.rlike(pattern) if needs is None else needs & text.rlike(pattern)
    return F.when(matches, let(parts, placed)).otherwise(F.array().cast(SPAN_TYPE)).cast(SPAN_TYPE)


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def by_start(spans: Column, kinds: list[str]) -> Column:
    """Spans by start, then by kind as listed."""
    place = lambda s: F.array_position(F.array(*map(F.lit, kinds)), s["kind"])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), place(s).alias("b"), s["end"].alias("c"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    value = lambda i: F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
    added = lambda i: F.when(i % 2 == 0, value(i)).otherwise(2 * value(i) - F.when(value(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda s, i: s + added(i)) % 10 == 0
