"""Queries: expressions, their residues, claims checked by residues, cycles and exact values."""

from __future__ import annotations

from math import prod

from pyspark.sql import functions as F

from ..functions import bigint as B
from ..functions import digital as D
from ..functions.numbers import MODULI
from ..operators import cycles as Y
from .query import query

_MADE = """CASE o_orderkey % 6 WHEN 0 THEN (o_custkey % 50 + 2) || '^' || (o_orderkey % 40) WHEN 1 THEN 'fib(' || (o_orderkey % 80) || ')' WHEN 2 THEN (o_orderkey % 19) || '!' WHEN 3 THEN o_orderkey || ' * ' || o_custkey || '*-3'
    WHEN 4 THEN o_orderkey || ' + ' || o_custkey || '+ -17' ELSE 'so ' || o_orderkey END || CASE WHEN o_orderkey % 4 = 0 THEN ' mod 97' ELSE '' END"""
_X = f"x AS (SELECT o_orderkey, o_custkey, {_MADE} AS s FROM orders)"
_PARTS = r"""p AS (SELECT *, regexp_replace(regexp_replace(s, '\s+mod\s+[0-9]+$', ''), '\s+', '', 'g') AS c, TRY_CAST(nullif(regexp_extract(s, '\smod\s+([0-9]+)$', 1), '') AS BIGINT) AS modulus FROM x),
f AS (SELECT *, CASE WHEN regexp_full_match(c, '[0-9]+\^[0-9]+') THEN 'power' WHEN regexp_full_match(c, 'fib\([0-9]+\)') THEN 'fibonacci' WHEN regexp_full_match(c, '[0-9]+!') THEN 'factorial' WHEN contains(c, '*') THEN 'bigprod' WHEN contains(c, '+') THEN 'bigsum' END AS family,
    list_transform(regexp_extract_all(c, '-?[0-9]+'), lambda y: CAST(y AS BIGINT)) AS v FROM p)"""


@query(f"""
WITH {_X}, {_PARTS} SELECT o_orderkey, family, CASE WHEN family = 'power' THEN v[1] END AS base, CASE family WHEN 'power' THEN v[2] WHEN 'fibonacci' THEN v[1] WHEN 'factorial' THEN v[1] END AS exponent,
       CASE WHEN family IN ('bigprod', 'bigsum') THEN array_to_string(v, ' ') END AS terms, CASE WHEN family IS NOT NULL THEN modulus END AS modulus FROM f""")
def parsed_expressions(t):
    e = t.orders.select("o_orderkey", D.parse(F.expr(_MADE)).alias("e"))
    return e.select("o_orderkey", "e.family", "e.base", "e.exponent", F.array_join("e.values", " ").alias("terms"), "e.modulus")


_RESIDUE = lambda m: f"""CASE family WHEN 'power' THEN CAST(list_reduce(list_concat([1::HUGEINT], list_transform(range(v[2]), lambda i: v[1]::HUGEINT)), lambda a, y: a * y % {m}) % {m} AS BIGINT) WHEN 'fibonacci' THEN CAST((SELECT fib FROM fibs WHERE n = v[1]) % {m} AS BIGINT)
    WHEN 'factorial' THEN CAST(CAST(factorial(CAST(v[1] AS INTEGER)) AS HUGEINT) % {m} AS BIGINT) WHEN 'bigprod' THEN CAST(((v[1]::HUGEINT * v[2] * v[3]) % {m} + {m}) % {m} AS BIGINT) WHEN 'bigsum' THEN ((v[1] + v[2] + v[3]) % {m} + {m}) % {m} END"""  # noqa: E731
_FIBS = "fibs AS (SELECT 0 AS n, 0::HUGEINT AS fib, 1::HUGEINT AS nxt UNION ALL SELECT n + 1, nxt, fib + nxt FROM fibs WHERE n < 90)"


@query(f"WITH RECURSIVE {_FIBS}, {_X}, {_PARTS} SELECT o_orderkey, family, {', '.join(f'{_RESIDUE(m)} AS r{m}' for m in MODULI)} FROM f WHERE family IS NOT NULL")
def expression_residues(t):
    """Five families modulo the default bank, without expanding them."""
    e = t.orders.select("o_orderkey", D.parse(F.expr(_MADE)).alias("e")).filter("e IS NOT NULL")
    return e.select("o_orderkey", "e.family", *(D.residue(F.col("e"), m).alias(f"r{m}") for m in MODULI))


_BANKS = {"digital_root_only": (9,), "small_7_9_11": (7, 9, 11), "default_7_9_11_13_37_101": MODULI, "extended_default_41_43": (*MODULI, 41, 43)}
_OFFSET = "1 + (l_orderkey * 7 + l_linenumber * 1000003) % 1000000 + CASE WHEN l_orderkey % 50 = 0 THEN 33666632 - (l_orderkey * 7 + l_linenumber * 1000003) % 1000000 ELSE 0 END"


@query(" UNION ALL ".join(f"""SELECT '{b}' AS bank, {prod(ms)}::BIGINT AS combined_modulus, count(*) AS checks, count(*) FILTER (WHERE {' OR '.join(f'o % {m} <> 0' for m in ms)}) AS ruled_out, count(*) FILTER (WHERE {' AND '.join(f'o % {m} = 0' for m in ms)}) AS escaped,
    bool_and(o % {prod(ms)} = 0 OR {' OR '.join(f'o % {m} <> 0' for m in ms)}) AS escapes_are_multiples FROM (SELECT {_OFFSET} AS o FROM lineitem)""" for b, ms in _BANKS.items()))  # fmt: skip
def bank_verification(t):
    """Claims of products, each off by an offset, verified as decimal strings against every bank in one pass."""
    claim = (F.col("l_orderkey") * F.col("l_partkey") + F.expr(_OFFSET)).cast("string")
    made = t.lineitem.select(F.expr(_OFFSET).alias("o"), "l_orderkey", "l_partkey", D.digits_residue(claim, prod(_BANKS["extended_default_41_43"])).alias("r"))
    wrong = lambda m: F.pmod("l_orderkey", F.lit(m)) * F.pmod("l_partkey", F.lit(m)) % m != F.col("r") % m

    def ruled(ms):
        some = F.lit(False)
        for m in ms:
            some = some | wrong(m)
        return some

    counts = made.agg(F.count("*").alias("checks"), *(F.count_if(ruled(ms)).alias(b) for b, ms in _BANKS.items()), *(F.bool_and(ruled(ms) | (F.col("o") % prod(ms) == 0)).alias(f"{b}_fit") for b, ms in _BANKS.items()))
    each = F.array(*(F.struct(F.lit(b).alias("bank"), F.lit(prod(ms)).cast("long").alias("combined_modulus"), F.col(b).alias("ruled_out"), F.col(f"{b}_fit").alias("escapes_are_multiples")) for b, ms in _BANKS.items()))
    return counts.select("checks", F.explode(each).alias("x")).select("x.bank", "x.combined_modulus", "checks", "x.ruled_out", (F.col("checks") - F.col("x.ruled_out")).alias("escaped"), "x.escapes_are_multiples")


@query(f"SELECT o_orderkey, CASE WHEN o_custkey < {prod(MODULI)} THEN o_custkey ELSE o_custkey % {prod(MODULI)} END AS value, {prod(MODULI)}::BIGINT AS modulus_product, o_orderkey % 2 = 1 OR o_orderkey % 3 = 0 AS ambiguous FROM orders")
def reconstructed_numbers(t):
    """Numbers out of their remainders; without a bound up to the product of the moduli they stay ambiguous."""
    bound = F.when(F.col("o_orderkey") % 2 == 0, F.when(F.col("o_orderkey") % 3 == 0, prod(MODULI) + 1).otherwise(1_000_000))
    r = t.orders.select("o_orderkey", D.reconstruct([F.col("o_custkey") % m for m in MODULI], MODULI, bound).alias("r"))
    return r.select("o_orderkey", "r.*")


_M = "2 + p_partkey % 60"


@query(f"""
WITH RECURSIVE g AS (SELECT DISTINCT p_size AS base, {_M} AS m FROM part), s AS (SELECT base, m, 1 AS i, base % m AS v FROM g UNION ALL SELECT base, m, i + 1, v * base % m FROM s WHERE i < 2 * m + 1),
l AS (SELECT a.base, a.m, min(b.i - a.i) AS lam FROM s a JOIN s b ON b.base = a.base AND b.m = a.m AND b.v = a.v AND b.i > a.i WHERE a.i = a.m GROUP BY 1, 2),
u AS (SELECT a.base, a.m, l.lam, min(a.i) - 1 AS mu FROM s a JOIN l ON l.base = a.base AND l.m = a.m JOIN s b ON b.base = a.base AND b.m = a.m AND b.i = a.i + l.lam AND b.v = a.v GROUP BY 1, 2, 3),
f AS (SELECT m, 0 AS i, 0::BIGINT AS a, 1::BIGINT AS b FROM (SELECT DISTINCT m FROM g) UNION ALL SELECT m, i + 1, b, (a + b) % m FROM f WHERE i < 6 * m), q AS (SELECT m, min(i) AS period FROM f WHERE i > 0 AND a = 0 AND b = 1 GROUP BY 1)
SELECT p_partkey, {_M} AS modulus, u.mu, u.lam, q.period, (SELECT v FROM s WHERE s.base = p_size AND s.m = {_M} AND s.i = 1 + CASE WHEN p_partkey - 1 < u.mu THEN p_partkey - 1 ELSE u.mu + (p_partkey - 1 - u.mu) % u.lam END) AS power,
       (SELECT a FROM f WHERE f.m = {_M} AND f.i = p_partkey % q.period) AS fibonacci FROM part JOIN u ON u.base = p_size AND u.m = {_M} JOIN q ON q.m = {_M}""")
def residue_cycles(t):
    """Cycles of powers and Fibonacci numbers modulo small numbers, and large terms through them."""
    g = t.part.select("p_partkey", F.col("p_size").cast("long").alias("base"), F.expr(_M).cast("long").alias("modulus"))
    cycles = g.select("base", "modulus").distinct().withColumn("c", D.power_cycle(F.col("base"), F.col("modulus"))).withColumn("period", D.pisano_period(F.col("modulus")))
    found = g.join(cycles, ["base", "modulus"])
    n, c = F.col("p_partkey"), F.col("c")
    place = F.when(n - 1 < c["mu"], n - 1).otherwise(c["mu"] + (n - 1 - c["mu"]) % c["lam"]).cast("int")
    return found.select("p_partkey", "modulus", "c.mu", "c.lam", "period", F.get(c["sequence"], place).alias("power"), D.fibonacci_mod(n % F.col("period"), F.col("modulus")).alias("fibonacci"))


@query("""
WITH RECURSIVE b AS (SELECT 0 AS n, [1::BIGINT] AS r UNION ALL SELECT n + 1, list_transform(range(n + 2), lambda k: (CASE WHEN k = 0 THEN 0 ELSE r[k] END + CASE WHEN k = n + 1 THEN 0 ELSE r[k + 1] END) % 7) FROM b WHERE n < 60)
SELECT p_partkey, (SELECT CAST(sum(p_partkey // z) AS BIGINT) FROM (VALUES (5), (25), (125), (625), (3125), (15625), (78125)) v(z)) AS zeros, coalesce(b.r[p_partkey % 13 + 1], 0) AS binomial FROM part JOIN b ON b.n = p_size""")
def exact_by_structure(t):
    """Zeros at the end of a factorial, and binomials modulo 7 by their digits (0 where more are chosen than there are)."""
    return t.part.select("p_partkey", D.factorial_zeros(F.col("p_partkey")).alias("zeros"), D.binomial_mod(F.col("p_size"), F.col("p_partkey") % 13, 7).alias("binomial"))


#: Small files of rows that cost much each: dealt to so many tasks before anything is parsed. A number, as rows this narrow would be put together again.
_TASKS = 64
_WIDE = """CASE o_orderkey % 6 WHEN 0 THEN (o_custkey % 9 + 2) || '^' || (o_orderkey % 36) WHEN 1 THEN 'fib(' || (o_orderkey % 150) || ')' WHEN 2 THEN (o_orderkey % 30) || '!' WHEN 3 THEN o_orderkey || '00000000000 * ' || o_custkey || '*-3' WHEN 4 THEN o_orderkey || '000000000000000000000 + -' || o_custkey || '77777777777777777777777' ELSE 'so ' || o_orderkey END"""
_VALUES = """w AS (SELECT o_orderkey, o_custkey, CASE o_orderkey % 6 WHEN 0 THEN CAST(list_reduce(list_concat([1::HUGEINT], list_transform(range(o_orderkey % 36), lambda i: (o_custkey % 9 + 2)::HUGEINT)), lambda a, y: a * y) AS HUGEINT) WHEN 1 THEN (SELECT fib FROM fibs WHERE n = o_orderkey % 150)
    WHEN 2 THEN CAST(list_reduce(list_concat([1::HUGEINT], list_transform(range(1, o_orderkey % 30 + 1), lambda i: i::HUGEINT)), lambda a, y: a * y) AS HUGEINT) WHEN 3 THEN o_orderkey::HUGEINT * 100000000000 * o_custkey * -3 WHEN 4 THEN o_orderkey::HUGEINT * 1000000000000000000000 - (o_custkey::HUGEINT * 100000000000000000000000 + 77777777777777777777777) END AS v FROM orders)"""
_LONG_FIBS = "fibs AS (SELECT 0 AS n, 0::HUGEINT AS fib, 1::HUGEINT AS nxt UNION ALL SELECT n + 1, nxt, fib + nxt FROM fibs WHERE n < 150)"
_BIG_MODULUS = 99999999999999999999


@query(f"""
WITH RECURSIVE {_LONG_FIBS}, {_VALUES} SELECT o_orderkey, CAST(v AS VARCHAR) AS value, CAST(((v % m) + m) % m AS VARCHAR) AS answer, (v - c) % {prod(MODULI)} <> 0 AS ruled_out FROM (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN {_BIG_MODULUS}::HUGEINT ELSE 97::HUGEINT END AS m, v + CASE o_custkey % 3 WHEN 0 THEN 0 WHEN 1 THEN o_custkey ELSE {prod(MODULI)} END AS c FROM w)""")
def expanded_expressions(t):
    """Exact values of expressions of many digits, their answers under moduli of two and twenty digits, and claims about them held against residues."""
    off = F.when(F.col("o_custkey") % 3 == 0, 0).when(F.col("o_custkey") % 3 == 1, F.col("o_custkey")).otherwise(prod(MODULI)).cast("string")
    orders = t.orders.select("o_orderkey", "o_custkey").repartition(_TASKS, "o_orderkey")
    stated = orders.select("o_orderkey", off.alias("off"), F.expr(_WIDE).alias("s"), F.when(F.col("o_orderkey") % 2 == 0, str(_BIG_MODULUS)).otherwise("97").alias("m"))
    parsed = stated.select("o_orderkey", "off", D.parse(F.concat("s", F.lit(" mod "), "m")).alias("x"))
    valued = parsed.select("*", D.exact_value(F.col("x")).alias("value")).withColumn("claim", B.total(F.array("value", "off")))
    return valued.select("o_orderkey", "value", D.answer(F.col("x"), F.col("value")).alias("answer"), (D.verdict(F.col("x"), F.col("claim")) == "RULED_OUT_WRONG").alias("ruled_out"))


_BLOCKS = 200
_FOLD = lambda c, m: f"CAST(list_reduce(list_concat([0::BIGINT], list_transform(range({_BLOCKS}), lambda i: {c}::BIGINT)), lambda a, y: (a * 100000 + y) % {m}) AS BIGINT)"
_PRIME = 1_000_003


@query(f"""
WITH x AS (SELECT s_suppkey, {_FOLD('(10000 + s_suppkey % 90000)', _PRIME)} AS a, {_FOLD('(10000 + (s_nationkey * 3001 + s_suppkey) % 90000)', _PRIME)} AS b FROM supplier)
SELECT s_suppkey, a * b % {_PRIME} AS product, (a + b) % {_PRIME} AS total, a * b % {_PRIME} AS through_value FROM x""")
def thousand_digits(t):
    """Products and sums of integers of 1,000 digits each, modulo a prime: by residues alone, and from the product's own 2,000 digits."""
    digits = lambda c: F.repeat((10_000 + c % 90_000).cast("string"), _BLOCKS)
    suppliers = t.supplier.select("s_suppkey", "s_nationkey").repartition(_TASKS, "s_suppkey")
    made = suppliers.select("s_suppkey", digits(F.col("s_suppkey")).alias("a"), digits(F.col("s_nationkey") * 3001 + F.col("s_suppkey")).alias("b"))
    parsed = made.select("s_suppkey", D.parse(F.concat_ws(" * ", "a", "b")).alias("x"), D.parse(F.concat_ws("+", "a", "b")).alias("y"))
    valued = parsed.select("*", D.exact_value(F.col("x")).alias("v"))
    return valued.select("s_suppkey", D.residue(F.col("x"), _PRIME).alias("product"), D.residue(F.col("y"), _PRIME).alias("total"), D.digits_residue(F.col("v"), _PRIME).alias("through_value"))


_TRUE = "l_orderkey * l_partkey - 5000"
_SEED = "l_orderkey * 31 + l_linenumber"


@query(f"""
WITH x AS (SELECT l_orderkey, l_linenumber, {_TRUE} AS a, {_SEED} AS seed FROM lineitem), k AS (SELECT *, unnest([{', '.join(f"'{c}'" for c in D.CORRUPTIONS)}]) AS kind, CAST(abs(a) AS VARCHAR) AS s FROM x),
d AS (SELECT *, list_filter(range(1, length(s)), lambda i: s[i] <> s[i + 1])[1] AS i FROM k),
w AS (SELECT l_orderkey, l_linenumber, kind, a, CASE kind WHEN 'random_offset' THEN a + 1 + seed % 2000000 WHEN 'digit_transpose' THEN CASE WHEN i IS NULL THEN a + 10 ELSE CAST(left(s, i - 1) || s[i + 1] || s[i] || substring(s, i + 2) AS BIGINT) * CASE WHEN a < 0 THEN -1 ELSE 1 END END
    WHEN 'off_by_power10' THEN a + CAST(rpad('1', CAST(length(s) AS INTEGER), '0') AS BIGINT) WHEN 'sign_flip' THEN CASE WHEN a = 0 THEN 1 ELSE -a END WHEN 'off_by_multiple_of_9' THEN a + 9 * (1 + seed % 1000000) ELSE a + {prod(MODULI)} * (1 + seed % 3) END AS claim FROM d)
SELECT kind, count(*) AS n, count(*) FILTER (WHERE {' OR '.join(f'((claim - a) % {m}) <> 0' for m in MODULI)}) AS caught, CAST(sum(claim % 1000003) AS BIGINT) AS mark, bool_and({' OR '.join(f'((claim - a) % {m}) <> 0' for m in MODULI)}) AS all_caught FROM w GROUP BY 1""")
def corruption_catch_rates(t):
    """Answers spoilt in six ways, and how many of them residues rule out; multiples of the combined modulus escape."""
    wide = lambda c: F.pmod(c, F.lit(prod(MODULI)).cast("long"))
    answers = t.lineitem.select(F.expr(_TRUE).alias("a"), F.expr(_SEED).cast("long").alias("seed")).withColumn("r", wide(F.col("a")))
    spoilt = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), D.corrupted(F.col("a"), F.lit(k), F.col("seed")).alias("claim")) for k in D.CORRUPTIONS)))
    each = answers.select("r", spoilt.alias("x")).select("x.kind", "x.claim", "r", wide(F.col("x.claim")).alias("c"))
    # Both sides are residues modulo the product of the bank: a modulus differs where it does not divide their difference.
    wrong = F.lit(False)
    for m in MODULI:
        wrong = wrong | ((F.col("c") - F.col("r")) % m != 0)
    return each.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(wrong).alias("caught"), F.sum(F.col("claim") % 1000003).alias("mark"), F.bool_and(wrong).alias("all_caught"))


_STEPS = 700


@query(f"""
WITH RECURSIVE g AS (SELECT DISTINCT 1 + p_partkey % 3 AS c0, p_size % 4 AS c1, p_partkey % 2 AS x0, 1 AS x1, 2 + p_size % 11 AS m FROM part), s AS (SELECT *, 0 AS i, x0 % m AS a, x1 % m AS b FROM g UNION ALL SELECT c0, c1, x0, x1, m, i + 1, b, (c0 * a + c1 * b) % m FROM s WHERE i < {_STEPS}),
f AS (SELECT c0, c1, x0, x1, m, a, b, min(i) AS i FROM s GROUP BY ALL), k AS (SELECT c0, c1, x0, x1, m, count(*) AS seen FROM f GROUP BY ALL), u AS (SELECT k.*, s.i AS last, f.i AS mu FROM k JOIN s USING (c0, c1, x0, x1, m) JOIN f USING (c0, c1, x0, x1, m, a, b) WHERE s.i = k.seen)
SELECT p_partkey, u.mu AS mu, u.seen - u.mu AS lam, (SELECT a FROM s WHERE s.c0 = u.c0 AND s.c1 = u.c1 AND s.x0 = u.x0 AND s.m = u.m AND s.i = CASE WHEN 1000 + p_partkey < u.mu THEN 1000 + p_partkey ELSE u.mu + (1000 + p_partkey - u.mu) % (u.seen - u.mu) END) AS term
FROM part JOIN u ON u.c0 = 1 + p_partkey % 3 AND u.c1 = p_size % 4 AND u.x0 = p_partkey % 2 AND u.m = 2 + p_size % 11""")
def recurrence_cycles(t):
    """Second-order recurrences modulo small numbers: where they begin to repeat and after how many terms, and a far term by matrix powers."""
    g = t.part.select("p_partkey", F.array(1 + F.col("p_partkey") % 3, F.col("p_size") % 4).cast("array<bigint>").alias("coeffs"), F.array(F.col("p_partkey") % 2, F.lit(1)).cast("array<bigint>").alias("init"), (2 + F.col("p_size") % 11).cast("bigint").alias("m"))
    shapes = g.select("coeffs", "init", "m").distinct().withColumn("shape", F.to_json(F.struct("coeffs", "init", "m")))
    found = shapes.join(Y.cycles(shapes, "shape", "coeffs", "init", "m"), "shape").drop("shape")
    each = g.join(found, ["coeffs", "init", "m"]).withColumn("n", (1000 + F.col("p_partkey")).cast("bigint"))
    return each.select("p_partkey", "mu", "lam", Y.recurrence_term(F.col("coeffs"), F.col("init"), F.col("n"), F.col("m")).alias("term"))
