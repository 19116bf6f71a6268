"""Residues of expressions, Chinese remainders, cycles and exact values, as column expressions.

An expression is a struct(family, base, exponent, values, modulus, texts): power (base, exponent), fibonacci and
factorial (exponent is n), bigprod and bigsum (values); texts holds the same as decimal strings, of any length. Moduli are at most 2^31, so that products of residues fit a long.
"""

from __future__ import annotations

from math import gcd, prod

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import bigint as B
from .numbers import MODULI

_LONG = "bigint"
_INT = r"[+-]?[0-9]++"
#: Factors that are multiplied one by one for a factorial's residue, and digits that exact values may have.
MOST_FACTORS, MOST_DIGITS = 5_000_000, 20_000


def _let(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def parse(text: Column) -> Column:
    """The expression that a text states, or null: b^e, b**e, fib(n), fibonacci(n), n!, a*b*..., a+b+..., each with "mod m" behind it or not (m over 1).

    Give it a column of its own before it is used: expressions in one another are slow to plan. Integers have any number
    of digits: base, exponent, values and modulus are numbers where a long holds them, and the
    same as decimal strings under texts.
    """
    modular = r"(?i)^(.*\S)\s++mod\s++([0-9]++)$"
    power, fib, fact = rf"^({_INT})(?:\*\*|\^)([0-9]++)$", r"(?i)^fib(?:onacci)?\(([0-9]++)\)$", r"^([0-9]++)!$"
    none, number = F.lit(None).cast("string"), lambda x: x.try_cast(_LONG)
    canonical = lambda x: _let(B.magnitude(x), lambda d: F.when(d == "", "0").when(x.startswith("-"), F.concat(F.lit("-"), d)).otherwise(d))
    made = lambda family, base=none, exponent=none, values=F.lit(None).cast("array<string>"): F.struct(F.lit(family).alias("family"), base.alias("base"), exponent.alias("exponent"), values.alias("values"))

    def stated(c: Column) -> Column:
        group = lambda pattern, n: canonical(F.regexp_extract(c, pattern, n))
        terms = lambda sign: F.transform(F.split(c, rf"\{sign}(?=[+-]?[0-9])"), canonical)
        return (
            F.when(c.rlike(power), made("power", group(power, 1), group(power, 2))).when(c.rlike(r"\*\*|\^"), F.lit(None))
            .when(c.rlike(fib), made("fibonacci", exponent=group(fib, 1))).when(c.rlike(fact), made("factorial", exponent=group(fact, 1)))
            .when(c.rlike(rf"^{_INT}(?:\*{_INT})++$"), made("bigprod", values=terms("*"))).when(c.rlike(rf"^{_INT}(?:\+{_INT})++$"), made("bigsum", values=terms("+")))
        )

    def whole(x: Column, m: Column) -> Column:
        numbers = F.transform(x["values"], number)
        texts = F.struct(x["base"].alias("base"), x["exponent"].alias("exponent"), x["values"].alias("values"), m.alias("modulus"))
        built = F.struct(x["family"].alias("family"), number(x["base"]).alias("base"), number(x["exponent"]).alias("exponent"), F.when(~F.exists(numbers, lambda v: v.isNull()), numbers).alias("values"), number(m).alias("modulus"), texts.alias("texts"))
        return F.when(x.isNotNull() & (m.isNull() | ~m.isin("0", "1")), built)

    modulus = lambda w: F.when(w.rlike(modular), canonical(F.regexp_extract(w, modular, 2)))
    compact = lambda w: F.regexp_replace(F.when(w.rlike(modular), F.regexp_extract(w, modular, 1)).otherwise(w), r"\s+", "")
    return _let(F.trim(text), lambda w: _let(modulus(w), lambda m: _let(_let(compact(w), stated), lambda x: whole(x, m))))


def _bits(n: Column) -> Column:
    """The binary digits of a long, highest first."""
    return F.transform(F.split(F.bin(n), ""), lambda b: b == "1")


def power_mod(base: Column, exponent: Column, m: Column) -> Column:
    """base to the exponent modulo m, by squaring."""
    b = F.pmod(base, m)
    return F.aggregate(_bits(exponent), F.pmod(F.lit(1).cast(_LONG), m), lambda a, bit: F.when(bit, a * a % m * b % m).otherwise(a * a % m))


def fibonacci_mod(n: Column, m: Column) -> Column:
    """The n-th Fibonacci number modulo m, by doubling."""
    begin = F.struct(F.lit(0).cast(_LONG).alias("a"), F.pmod(F.lit(1).cast(_LONG), m).alias("b"))

    def step(s: Column, bit: Column) -> Column:
        a, b = s["a"], s["b"]
        even, odd = a * F.pmod(2 * b - a, m) % m, (a * a % m + b * b % m) % m
        return F.struct(F.when(bit, odd).otherwise(even).alias("a"), F.when(bit, (even + odd) % m).otherwise(odd).alias("b"))

    return F.aggregate(_bits(n), begin, step)["a"]


def factorial_mod(n: Column, m: Column) -> Column:
    """n! modulo m; from n = m on it is 0. Null for more than MOST_FACTORS factors."""
    product = F.aggregate(F.sequence(F.lit(1).cast(_LONG), F.greatest(n, F.lit(1))), F.pmod(F.lit(1).cast(_LONG), m), lambda a, v: a * (v % m) % m)
    return F.when(n >= m, F.lit(0).cast(_LONG)).when(n <= MOST_FACTORS, product)


def _figures(n: Column) -> Column:
    """The decimal digits of a string, highest first."""
    return F.transform(F.filter(F.split(n, ""), lambda d: d != ""), lambda d: d.cast("int"))


def power_of_digits(base: Column, exponent: Column, m: Column) -> Column:
    """base (a residue) to an exponent of any length, given as a decimal string, modulo m: a digit at a time."""
    low = F.aggregate(F.sequence(F.lit(1), F.lit(9)), F.array(F.pmod(F.lit(1).cast(_LONG), m)), lambda t, _: F.concat(t, F.array(F.element_at(t, -1) * base % m)))
    tenth = lambda r: _let(r * r % m, lambda s: _let(s * s % m * r % m, lambda f: f * f % m))
    return _let(low, lambda t: F.aggregate(_figures(exponent), F.pmod(F.lit(1).cast(_LONG), m), lambda r, d: tenth(r) * F.get(t, d) % m))


def fibonacci_of_digits(n: Column, m: Column) -> Column:
    """The Fibonacci number of an index of any length, given as a decimal string, modulo m: a digit at a time."""
    pair = lambda a, b: F.struct(F.pmod(a, m).alias("a"), F.pmod(b, m).alias("b"))
    # From F(i), F(i+1) and F(j), F(j+1) to those of i + j.
    both = lambda x, y: pair(x["a"] * y["b"] % m + F.pmod(x["b"] - x["a"], m) * y["a"] % m, x["a"] * y["a"] % m + x["b"] * y["b"] % m)
    low = F.array(*(pair(F.lit(a).cast(_LONG), F.lit(b).cast(_LONG)) for a, b in ((0, 1), (1, 1), (1, 2), (2, 3), (3, 5), (5, 8), (8, 13), (13, 21), (21, 34), (34, 55))))
    tenth = lambda s: _let(both(s, s), lambda two: _let(both(two, two), lambda four: _let(both(four, s), lambda five: both(five, five))))
    return _let(low, lambda t: F.aggregate(_figures(n), F.get(t, F.lit(0)), lambda s, d: both(tenth(s), F.get(t, d)))["a"])


def residue(expr: Column, m: Column | int) -> Column:
    """The expression modulo m (at most 2^31), without its value; its integers have any number of digits. Null for a factorial of over MOST_FACTORS below m."""
    return _let(expr, lambda e: _residue(e, (F.lit(m) if isinstance(m, int) else m).cast(_LONG)))


def _residue(expr: Column, m: Column) -> Column:
    begin, texts = F.lit(0).cast(_LONG), expr["texts"]
    short = lambda x: F.length(x) <= 18
    of = lambda x: digits_residue(x, m)
    base = F.when(expr["base"].isNotNull(), F.pmod(expr["base"], m)).otherwise(of(texts["base"]))
    terms = F.when(expr["values"].isNotNull(), F.transform(expr["values"], lambda v: F.pmod(v, m))).otherwise(F.transform(texts["values"], of))
    n = F.when(short(texts["exponent"]), expr["exponent"])
    return (
        F.when(expr["family"] == "power", F.when(n.isNotNull(), power_mod(base, n, m)).otherwise(power_of_digits(base, texts["exponent"], m)))
        .when(expr["family"] == "fibonacci", F.when(n.isNotNull(), fibonacci_mod(n, m)).otherwise(fibonacci_of_digits(texts["exponent"], m)))
        .when(expr["family"] == "factorial", F.when(n.isNotNull(), factorial_mod(n, m)).otherwise(begin)).when(expr["family"] == "bigsum", F.aggregate(terms, begin, lambda a, v: (a + v) % m))
        .when(expr["family"] == "bigprod", F.aggregate(terms, F.pmod(F.lit(1).cast(_LONG), m), lambda a, v: a * v % m))
    )


def exact_value(expr: Column) -> Column:
    """The value of an expression (a column of its own) as a decimal string; null where it would have over MOST_DIGITS digits."""
    return B.evaluated(expr["family"], _let(expr, _operands))


def _operands(expr: Column) -> Column:
    """What the expression's value is made of, with one space between; null where it isn't to be made."""
    n, texts, family = expr["exponent"], expr["texts"], expr["family"]
    size = lambda x: F.length(B.magnitude(x))
    odd = F.substring(texts["exponent"], -1, 1).isin("1", "3", "5", "7", "9")
    small = lambda bound: F.when(n <= bound, texts["exponent"])
    whole = F.when(size(texts["base"]) <= 1, F.when(B.magnitude(texts["base"]).isin("", "1"), True))  # 0, 1 and -1 to any exponent
    trivial = F.when(texts["exponent"] == "0", "1").when(B.magnitude(texts["base"]) == "", "0").otherwise(F.when(texts["base"].startswith("-") & odd, "-1").otherwise("1"))
    raised = F.when(whole | (texts["exponent"] == "0"), F.concat(trivial, F.lit(" 1"))).when(n * size(texts["base"]) <= MOST_DIGITS, F.concat(texts["base"], F.lit(" "), small(MOST_DIGITS * 4)))
    sized = F.aggregate(F.transform(texts["values"], size), F.lit(0), lambda a, x: a + x)
    return (
        F.when(family == "power", raised).when(family == "fibonacci", small(MOST_DIGITS * 4)).when(family == "factorial", small(MOST_DIGITS // 4))
        .when(family.isin("bigsum", "bigprod") & (sized <= MOST_DIGITS), F.array_join(texts["values"], " "))
    )


def answer(expr: Column, value: Column) -> Column:
    """The expression modulo its own modulus, of any size, as a decimal string; without a modulus its value (its exact_value(), in a column of its own). Null where neither can be had."""
    m, short = expr["texts"]["modulus"], expr["modulus"].isNotNull() & (expr["modulus"] <= 2**31)
    through_value = B.remainder(F.when(~short, value), m)
    return F.when(m.isNull(), value).when(short, residue(expr, expr["modulus"]).cast("string")).otherwise(through_value)


def digits_residue(digits: Column, m: int | Column) -> Column:
    """A decimal string of any length modulo m (under 2^33), nine digits at a time; a leading minus gives the non-negative residue."""
    m = (F.lit(m) if isinstance(m, int) else m).cast(_LONG)
    body = F.regexp_replace(digits, "^[-+]", "")
    whole = F.lpad(body, F.ceil(F.length(body) / 9).cast("int") * 9, "0")
    chunks = F.transform(F.regexp_extract_all(whole, F.lit("([0-9]{9})"), F.lit(1)), lambda x: x.cast(_LONG))
    folded = F.when(F.length(body) <= 18, body.cast(_LONG) % m).otherwise(F.aggregate(chunks, F.lit(0).cast(_LONG), lambda a, c: (a * 1_000_000_000 + c) % m))
    return F.when(digits.startswith("-"), F.pmod(-folded, m)).otherwise(folded)


def residues(digits: Column, moduli: tuple[int, ...] = MODULI) -> Column:
    """Residues of a decimal string modulo each of the pairwise coprime moduli, folded once modulo their product."""
    return _let(digits_residue(digits, prod(moduli)), lambda r: F.array(*(r % m for m in moduli)))


def verdict(expr: Column, claim: Column, moduli: tuple[int, ...] = MODULI) -> Column:
    """RULED_OUT_WRONG where a claimed decimal string differs from the expression modulo one of the moduli; agreement proves nothing. Null where there is no expression."""
    each = lambda e: F.array(*(_residue(e, F.lit(m).cast(_LONG)) for m in moduli))
    # Once modulo the product where that is small enough; a factorial's factors would then not end at the greatest modulus.
    whole = lambda e: _let(_residue(e, F.lit(prod(moduli)).cast(_LONG)), lambda r: F.array(*(r % m for m in moduli)))
    own = _let(expr, lambda e: F.when(e["family"] == "factorial", each(e)).otherwise(whole(e))) if prod(moduli) <= 2**31 else _let(expr, each)
    return F.when(own == residues(claim, moduli), "NOT_RULED_OUT").when(expr.isNotNull(), "RULED_OUT_WRONG")


def pairwise_coprime(moduli: tuple[int, ...]) -> bool:
    return all(m > 1 for m in moduli) and all(gcd(a, b) == 1 for i, a in enumerate(moduli) for b in moduli[i + 1 :])


def reconstruct(remainders: list[Column], moduli: tuple[int, ...], upper_bound: Column | None = None) -> Column:
    """struct(value, modulus_product, ambiguous) from the remainders; certain only where upper_bound is at most the product."""
    if not pairwise_coprime(moduli):
        raise ValueError("the moduli share a factor")
    whole = prod(moduli)
    total = sum((F.pmod(r.cast(_LONG), F.lit(m).cast(_LONG)) * (whole // m * pow(whole // m, -1, m)) % whole for r, m in zip(remainders, moduli)), F.lit(0).cast(_LONG))
    ambiguous = F.lit(True) if upper_bound is None else ~F.coalesce((upper_bound >= 0) & (upper_bound <= whole), F.lit(False))
    return F.struct((total % whole).alias("value"), F.lit(whole).cast(_LONG).alias("modulus_product"), ambiguous.alias("ambiguous"))


def power_cycle(base: Column, m: Column) -> Column:
    """struct(mu, lam, sequence): base^1, base^2, ... modulo m go round every lam terms from term mu on (m small: 2 m terms are looked at)."""
    m = m.cast(_LONG)
    b = F.pmod(base.cast(_LONG), m)
    terms = F.aggregate(F.sequence(F.lit(2).cast(_LONG), 2 * m + 1), F.array(b), lambda s, _: F.concat(s, F.array(F.element_at(s, -1) * b % m)))

    def of(t: Column) -> Column:
        # The m-th term lies on the cycle: the next term equal to it tells the length.
        lam = F.array_position(F.slice(t, m.cast("int") + 1, m.cast("int") + 1), F.element_at(t, m.cast("int")))
        return _let(lam.cast("int"), lambda n: _let(F.filter(F.sequence(F.lit(0), m.cast("int")), lambda i: F.get(t, i) == F.get(t, i + n))[0], lambda mu: F.struct(mu.cast(_LONG).alias("mu"), n.cast(_LONG).alias("lam"), F.slice(t, 1, mu + n).alias("sequence"))))

    return _let(terms, of)


def pisano_period(m: Column) -> Column:
    """After how many terms the Fibonacci numbers modulo m go round (at most 6 m)."""
    m = m.cast(_LONG)
    begin = F.struct(F.lit(0).cast(_LONG).alias("a"), F.pmod(F.lit(1).cast(_LONG), m).alias("b"), F.lit(0).cast(_LONG).alias("n"))

    def step(s: Column, i: Column) -> Column:
        b = (s["a"] + s["b"]) % m
        back = (s["n"] == 0) & (s["b"] == 0) & (b == F.pmod(F.lit(1).cast(_LONG), m))
        return F.struct(s["b"].alias("a"), b.alias("b"), F.when(back, i).otherwise(s["n"]).alias("n"))

    return F.aggregate(F.sequence(F.lit(1).cast(_LONG), 6 * m), begin, step)["n"]


def power_by_cycle(base: Column, exponent: Column, m: Column) -> Column:
    """base to the exponent modulo m through its cycle."""
    at = lambda c: F.when(exponent - 1 < c["mu"], exponent - 1).otherwise(c["mu"] + F.pmod(exponent - 1 - c["mu"], c["lam"])).cast("int")
    return F.when(exponent == 0, F.pmod(F.lit(1).cast(_LONG), m.cast(_LONG))).otherwise(_let(power_cycle(base, m), lambda c: F.get(c["sequence"], at(c))))


def fibonacci_by_cycle(n: Column, m: Column) -> Column:
    return fibonacci_mod(F.pmod(n.cast(_LONG), pisano_period(m)), m.cast(_LONG))


def factorial_zeros(n: Column) -> Column:
    """Zeros at the end of n!."""
    return F.aggregate(F.array(*(F.lit(5**i) for i in range(1, 27))), F.lit(0).cast(_LONG), lambda s, p: s + F.floor(n / p))


def binomial_mod(n: Column, k: Column, p: int) -> Column:
    """n over k modulo a small prime, digit by digit in base p."""
    table = [[1 if j == 0 else 0 for j in range(p)] for _ in range(p)]
    for i in range(1, p):
        for j in range(1, i + 1):
            table[i][j] = (table[i - 1][j - 1] + table[i - 1][j]) % p
    small = F.array(*(F.array(*(F.lit(x).cast(_LONG) for x in row)) for row in table))
    begin = F.struct(n.cast(_LONG).alias("n"), k.cast(_LONG).alias("k"), F.lit(1).cast(_LONG).alias("v"))
    step = lambda s, _: F.struct(F.floor(s["n"] / p).alias("n"), F.floor(s["k"] / p).alias("k"), (s["v"] * F.get(F.get(small, (s["n"] % p).cast("int")), (s["k"] % p).cast("int")) % p).alias("v"))
    places = 1
    while p**places < 2**53:
        places += 1
    return F.aggregate(F.sequence(F.lit(1), F.lit(places)), begin, step)["v"]


#: The ways in which an answer is spoilt.
CORRUPTIONS = ("random_offset", "digit_transpose", "off_by_power10", "sign_flip", "off_by_multiple_of_9", "off_by_combined_modulus")


def corrupted(answer: Column, kind: Column, seed: Column) -> Column:
    """A wrong answer (a long, under 10^17 in size) of the kind asked for; seed, a long, stands in for chance."""
    size = F.abs(answer).cast("string")
    differ = F.filter(F.sequence(F.lit(1), F.greatest(F.length(size) - 1, F.lit(1))), lambda i: F.substring(size, i, F.lit(1)) != F.substring(size, i + 1, F.lit(1)))
    swapped = lambda i: (F.concat(F.substring(size, F.lit(1), i - 1), F.substring(size, i + 1, F.lit(1)), F.substring(size, i, F.lit(1)), F.substring(size, i + 2, F.length(size)))).cast(_LONG) * F.when(answer < 0, -1).otherwise(1)
    transposed = F.when((F.size(differ) > 0) & (F.length(size) > 1), _let(F.element_at(differ, 1), swapped)).otherwise(answer + 10)
    return (
        F.when(kind == "random_offset", answer + 1 + F.pmod(seed, F.lit(2_000_000))).when(kind == "digit_transpose", transposed)
        .when(kind == "off_by_power10", answer + F.rpad(F.lit("1"), F.length(size), "0").cast(_LONG)).when(kind == "sign_flip", F.when(answer == 0, 1).otherwise(-answer))
        .when(kind == "off_by_multiple_of_9", answer + 9 * (1 + F.pmod(seed, F.lit(1_000_000)))).when(kind == "off_by_combined_modulus", answer + prod(MODULI) * (1 + F.pmod(seed, F.lit(3))))
    )
