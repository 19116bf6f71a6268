"""Cycles in constant memory and terms by matrix powers against plain loops."""

import random
import time

from pyspark.sql import functions as F

from sievemark.operators import cycles as Y


def plain(coeffs, init, m):
    seen, state, i = {}, tuple(x % m for x in init), 0
    while state not in seen:
        seen[state] = i
        state, i = (*state[1:], sum(c * x for c, x in zip(coeffs, state)) % m), i + 1
    return seen[state], i - seen[state]


def test_recurrences_of_any_order(spark):
    rng = random.Random(41)
    cases = [([rng.randrange(-5, 9) for _ in range(k)], [rng.randrange(-3, 9) for _ in range(k)], rng.randrange(2, 40)) for k in (1, 1, 2, 2, 3, 3, 4) for _ in range(12)]
    rows = [(i, c, x, m, rng.randrange(10**12)) for i, (c, x, m) in enumerate(cases)]
    df = spark.createDataFrame(rows, "id long, c array<long>, x array<long>, m long, n long")
    found = {r["id"]: (r["mu"], r["lam"]) for r in Y.cycles(df, "id", "c", "x", "m").collect()}
    assert found == {i: plain(*case) for i, case in enumerate(cases)}
    terms = df.select("id", Y.recurrence_term(F.col("c"), F.col("x"), F.col("n"), F.col("m")).alias("t")).collect()
    for (_, c, x, m, n), (i, term) in zip(rows, sorted(map(tuple, terms))):
        mu, lam = plain(c, x, m)
        values = [v % m for v in x]
        for _ in range(mu + lam):
            values.append(sum(a * b for a, b in zip(c, values[-len(c) :])) % m)
        assert term == values[n if n < mu else mu + (n - mu) % lam], (c, x, m, n)


def test_moduli_of_a_million(spark):
    rows = [(1, [3], [3], 1_000_003), (2, [1, 1], [0, 1], 1_000_000), (3, [10], [10], 2**10 * 999_983), (4, [1, 1, 1], [0, 0, 1], 1_009)]
    begun = time.time()
    found = {r["id"]: (r["mu"], r["lam"]) for r in Y.cycles(spark.createDataFrame(rows, "id long, c array<long>, x array<long>, m long"), "id", "c", "x", "m").collect()}
    assert found[2] == (0, 1_500_000) and found[1][0] == 0 and pow(3, found[1][1], 1_000_003) == 1 and found[3][0] == 9 and found[4] == plain(*rows[3][1:])
    assert time.time() - begun < 60


def test_missing_and_odd_parts_are_null(spark):
    rows = [(1, None, [1], 5), (2, [1], [1, 2], 5), (3, [1], [1], 1), (4, [1], [1], None), (5, [None], [1], 5), (6, [], [], 5)]
    found = Y.cycles(spark.createDataFrame(rows, "id long, c array<long>, x array<long>, m long"), "id", "c", "x", "m").collect()
    assert len(found) == 6 and all(r["mu"] is None and r["lam"] is None for r in found)
    assert Y.brent(lambda x: x + 1, 0, most=1_000) is None
