"""Integers of any size: as decimal strings that Python's own integers evaluate in Arrow batches, and as arrays of limbs in base 10^7, least first (zero is the empty array).

Products of limbs are added up column by column before carries are taken, which a long holds for over 90,000 limbs. A
product of 1,000 digits costs about 20,000 steps of a lambda that Spark interprets: whole tables go through evaluated().
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

PLACES = 7
BASE = 10**PLACES
_ARRAY = "array<bigint>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def _zero() -> Column:
    return F.lit(0).cast("bigint")


def magnitude(text: Column) -> Column:
    """The digits of a decimal string without sign and leading zeros (zero: empty)."""
    return F.regexp_replace(text, "^[+-]?0*", "")


def limbs(text: Column) -> Column:
    """The limbs of a decimal string's size, whatever its sign."""
    return let(magnitude(text), lambda d: F.reverse(F.transform(F.regexp_extract_all(F.lpad(d, F.ceil(F.length(d) / PLACES).cast("int") * PLACES, "0"), F.lit(f"([0-9]{{{PLACES}}})"), F.lit(1)), lambda x: x.cast("bigint"))))


def digits(a: Column) -> Column:
    """The decimal string of limbs."""
    return let(a, _digits)


def _digits(a: Column) -> Column:
    joined = F.array_join(F.transform(F.reverse(a), lambda x: F.lpad(x.cast("string"), PLACES, "0")), "")
    return F.when(F.size(a) == 0, "0").otherwise(F.regexp_replace(joined, "^0+", ""))


def _trimmed(a: Column) -> Column:
    last = F.coalesce(F.array_max(F.transform(a, lambda x, i: F.when(x != 0, i + 1).otherwise(0))), F.lit(0))
    return F.slice(a, F.lit(1), last)


def _carried(columns: Column) -> Column:
    """Columns of any size as limbs."""
    begin = F.struct(F.array().cast(_ARRAY).alias("done"), _zero().alias("over"))
    step = lambda s, x: let(x + s["over"], lambda v: F.struct(F.concat(s["done"], F.array(v % BASE)).alias("done"), F.call_function("div", v, F.lit(BASE).cast("bigint")).alias("over")))
    rest = lambda o: F.array(o % BASE, F.call_function("div", o, F.lit(BASE).cast("bigint")) % BASE, F.call_function("div", o, F.lit(BASE**2).cast("bigint")))
    return let(F.aggregate(columns, begin, step), lambda s: _trimmed(F.concat(s["done"], rest(s["over"]))))


def add(a: Column, b: Column) -> Column:
    return _carried(F.zip_with(a, b, lambda x, y: F.coalesce(x, _zero()) + F.coalesce(y, _zero())))


def scaled(a: Column, by: Column, plus: Column) -> Column:
    """a * by + plus, for numbers under 10^11."""
    return _carried(F.transform(F.when(F.size(a) == 0, F.array(_zero())).otherwise(a), lambda x, i: x * by + F.when(i == 0, plus).otherwise(0)))


def less(a: Column, b: Column) -> Column:
    return let(a, lambda x: let(b, lambda y: _less(x, y)))


def _less(a: Column, b: Column) -> Column:
    return F.when(F.size(a) != F.size(b), F.size(a) < F.size(b)).otherwise(F.reverse(a) < F.reverse(b))


def subtract(a: Column, b: Column) -> Column:
    """a - b, where b is at most a."""
    begin = F.struct(F.array().cast(_ARRAY).alias("done"), _zero().alias("owed"))
    step = lambda s, x: let(x - s["owed"], lambda v: F.struct(F.concat(s["done"], F.array(F.when(v < 0, v + BASE).otherwise(v))).alias("done"), (v < 0).cast("bigint").alias("owed")))
    return _trimmed(F.aggregate(F.zip_with(a, b, lambda x, y: x - F.coalesce(y, _zero())), begin, step)["done"])


def multiply(a: Column, b: Column) -> Column:
    """a * b; as both are read often, they should be columns or variables, not expressions."""
    n, m = F.size(a), F.size(b)

    def column(k: Column, r: Column) -> Column:
        low = F.greatest(F.lit(0), k - m + 1)
        size = F.least(k, n - 1) - low + 1
        return F.aggregate(F.zip_with(F.slice(a, low + 1, size), F.slice(r, m - k + low, size), lambda p, q: p * q), _zero(), lambda s, v: s + v)

    columns = let(F.reverse(b), lambda r: F.transform(F.sequence(F.lit(0), n + m - 2), lambda k: column(k, r)))
    return F.when((n == 0) | (m == 0), F.array().cast(_ARRAY)).otherwise(_carried(columns))


def modulo(a: Column, m: Column) -> Column:
    """a modulo m (limbs, over zero), digit by digit."""
    twice = lambda k: F.aggregate(F.sequence(F.lit(1), F.lit(3)), F.array(k), lambda t, _: F.concat(F.array(add(t[0], t[0])), t))
    # Ten times a remainder, and a digit, holds m up to nine times: 8, 4, 2 and 1 of it are taken off where they fit.
    reduced = lambda x, steps: F.aggregate(steps, x, lambda r, k: F.when(_less(r, k), r).otherwise(subtract(r, k)))

    def of(x: Column, steps: Column) -> Column:
        figures = F.filter(F.split(digits(x), ""), lambda d: d != "")
        return F.aggregate(figures, F.array().cast(_ARRAY), lambda r, d: reduced(scaled(r, F.lit(10).cast("bigint"), d.cast("bigint")), steps))

    return let(a, lambda x: F.when(_less(x, m), x).otherwise(let(twice(m), lambda steps: of(x, steps))))


def power(a: Column, exponent: Column) -> Column:
    """a to a long exponent, by squaring."""
    bits = F.transform(F.split(F.bin(exponent), ""), lambda b: b == "1")
    one = F.array(F.lit(1).cast("bigint"))
    squared = lambda r, bit, x: let(multiply(r, r), lambda s: F.when(bit, multiply(s, x)).otherwise(s))
    return let(a, lambda x: F.aggregate(bits, one, lambda r, bit: squared(r, bit, x)))


def factorial(n: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.greatest(n, F.lit(1).cast("bigint"))), F.array(F.lit(1).cast("bigint")), lambda r, i: scaled(r, i, _zero()))


def fibonacci(n: Column) -> Column:
    """The n-th Fibonacci number by doubling: three neighbours, so that nothing is subtracted."""
    bits = F.transform(F.split(F.bin(n), ""), lambda b: b == "1")
    one, none = F.array(F.lit(1).cast("bigint")), F.array().cast(_ARRAY)
    begin = F.struct(one.alias("a"), none.alias("b"), one.alias("c"))

    def step(s: Column, bit: Column) -> Column:
        squares = F.transform(F.array(s["a"], s["b"], s["c"]), lambda x: multiply(x, x))
        crossed = let(add(s["a"], s["c"]), lambda t: multiply(s["b"], t))
        # F(2k-1), F(2k) and F(2k+1).
        doubled = let(squares, lambda q: F.array(add(q[0], q[1]), crossed, add(q[1], q[2])))
        return let(doubled, lambda d: F.when(bit, F.struct(d[1].alias("a"), d[2].alias("b"), add(d[1], d[2]).alias("c"))).otherwise(F.struct(d[0].alias("a"), d[1].alias("b"), d[2].alias("c"))))

    return F.aggregate(bits, begin, step)["b"]


def signed(negative: Column, a: Column) -> Column:
    """The decimal string of limbs with a sign."""
    return let(digits(a), lambda d: F.when(negative & (d != "0"), F.concat(F.lit("-"), d)).otherwise(d))


def _fibonacci(n: int) -> int:
    a, b = 0, 1
    for bit in bin(n)[2:]:
        a, b = a * (2 * b - a), a * a + b * b
        if bit == "1":
            a, b = b, a + b
    return a


_MEANINGS = {"power": lambda v: v[0] ** v[1], "fibonacci": lambda v: _fibonacci(v[0]), "factorial": lambda v: math.factorial(v[0]), "bigsum": sum, "bigprod": math.prod, "modulo": lambda v: v[0] % v[1]}


@F.pandas_udf(StringType())
def evaluated(family: pd.Series, operands: pd.Series) -> pd.Series:
    """The decimal string of a family (power, fibonacci, factorial, bigsum, bigprod, modulo) of decimal strings with one space between them; null where there are none. Bounds are the caller's: every row is evaluated, also under a when()."""
    sys.set_int_max_str_digits(0)
    return pd.Series([None if f is None or o is None else str(_MEANINGS[f]([int(x) for x in o.split()])) for f, o in zip(family, operands)], dtype=object)


def total(values: Column) -> Column:
    """The sum of decimal strings with or without signs, as a decimal string."""
    return evaluated(F.lit("bigsum"), F.array_join(values, " "))


def product(values: Column) -> Column:
    """The product of decimal strings with or without signs, as a decimal string."""
    return evaluated(F.lit("bigprod"), F.array_join(values, " "))


def remainder(value: Column, m: Column) -> Column:
    """A decimal string modulo another one over zero, from zero on, as a decimal string."""
    return evaluated(F.lit("modulo"), F.concat(value, F.lit(" "), m))
