"""Cycles of linear recurrences modulo a number, in constant memory, and their terms by matrix powers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps after which a cycle is given up.
MOST_STEPS = 100_000_000


def brent(step: Callable[[Any], Any], start: Any, most: int = MOST_STEPS) -> tuple[int, int] | None:
    """(mu, lam) of the states from start on: lam states go round from state mu on. Two states are held; None after most steps."""
    slow, fast, power, lam, taken = start, step(start), 1, 1, 1
    while slow != fast:
        if power == lam:
            slow, power, lam = fast, 2 * power, 0
        fast = step(fast)
        lam += 1
        taken += 1
        if taken > most:
            return None
    slow = fast = start
    for _ in range(lam):
        fast = step(fast)
    mu = 0
    while slow != fast:
        slow, fast, mu = step(slow), step(fast), mu + 1
    return mu, lam


def _stepped(coeffs: list[int], init: list[int], m: int) -> tuple[Callable[[Any], Any], Any]:
    coeffs, start = [c % m for c in coeffs], tuple(x % m for x in init)
    if len(coeffs) == 1:
        (a,) = coeffs
        return lambda x: x * a % m, start[0]
    if len(coeffs) == 2:
        a, b = coeffs
        return lambda s: (s[1], (a * s[0] + b * s[1]) % m), start
    return lambda s: (*s[1:], sum(c * x for c, x in zip(coeffs, s)) % m), start


def cycles(df: DataFrame, key: str, coeffs: str, init: str, modulus: str, most: int = MOST_STEPS) -> DataFrame:
    """key, mu, lam: where the states of x(n+k) = coeffs . (x(n) ... x(n+k-1)) modulo a number begin to repeat, and after how many.

    coeffs and init are arrays of one length. Powers of b are coeffs [b], init [b]; Fibonacci numbers [1, 1], [0, 1]. Null
    where a part is missing, lengths differ, the modulus is under 2, or the cycle isn't found in most steps.
    """
    key_type = df.schema[key].dataType.simpleString()

    def found(c: list | None, x: list | None, m: int | None) -> tuple[int | None, int | None]:
        if not c or not x or len(c) != len(x) or m is None or m < 2 or None in c or None in x:
            return None, None
        return brent(*_stepped(c, x, m), most) or (None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [found(*row) for row in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["key", "mu", "lam"])

    asked = df.select(F.col(key).alias("key"), F.col(coeffs).cast("array<bigint>"), F.col(init).cast("array<bigint>"), F.col(modulus).cast("bigint"))
    return asked.mapInArrow(run, f"key {key_type}, mu long, lam long").withColumnRenamed("key", key)


def place_on_cycle(n: Column, mu: Column, lam: Column) -> Column:
    """The least index with the state of index n."""
    return F.when(n < mu, n).otherwise(mu + F.pmod(n - mu, lam))


def recurrence_term(coeffs: Column, init: Column, n: Column, m: Column) -> Column:
    """x(n) modulo m (at most 2^31) by squaring the companion matrix; the arguments should be columns of their own."""
    m = m.cast("bigint")
    k = F.size(coeffs)
    ids = F.sequence(F.lit(0), k - 1)
    one = lambda i, j: F.when(i == j, 1).otherwise(0).cast("bigint")
    identity = F.transform(ids, lambda i: F.transform(ids, lambda j: F.pmod(one(i, j), m)))
    companion = F.transform(ids, lambda i: F.transform(ids, lambda j: F.when(i == k - 1, F.pmod(F.get(coeffs, j), m)).otherwise(one(j, i + 1))))
    dot = lambda row, b, j: F.aggregate(F.zip_with(row, F.transform(b, lambda r: F.get(r, j)), lambda x, y: x * y % m), F.lit(0).cast("bigint"), lambda s, v: (s + v) % m)
    times = lambda a, b: F.transform(a, lambda row: F.transform(ids, lambda j: dot(row, b, j)))
    let = lambda v, use: F.element_at(F.transform(F.array(v), use), 1)
    bits = F.transform(F.split(F.bin(n), ""), lambda b: b == "1")
    power = let(companion, lambda c: F.aggregate(bits, identity, lambda r, bit: let(times(r, r), lambda s: F.when(bit, times(s, c)).otherwise(s))))
    start = F.transform(init, lambda x: F.pmod(x, m))
    return let(power, lambda p: F.aggregate(F.zip_with(F.get(p, F.lit(0)), start, lambda x, y: x * y % m), F.lit(0).cast("bigint"), lambda s, v: (s + v) % m))
