"""Integers of thousands of digits against Python's own."""

import random
import sys
from math import factorial, prod

from pyspark.sql import functions as F

from sievemark.functions import bigint as B
from sievemark.functions import digital
from sievemark.plans import registry

sys.set_int_max_str_digits(0)


def ask(spark, rows, names, *columns):
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    if "s" in names:
        df = df.withColumn("e", digital.parse(F.col("s"))).withColumn("v", digital.exact_value(F.col("e")))
    return df.select(*columns).collect()


def test_limbs(spark):
    rng = random.Random(21)
    pairs = [(rng.randrange(10**n), rng.randrange(10**m)) for n, m in ((1, 1), (7, 7), (8, 7), (30, 3), (200, 190), (14, 14))] + [(0, 5), (5, 0), (0, 0), (10**70 - 1, 1), (10**14, 10**7)]
    a, b = F.col("a"), F.col("b")
    x, y = B.limbs(a), B.limbs(b)
    big, small = F.when(B.less(x, y), y).otherwise(x), F.when(B.less(x, y), x).otherwise(y)
    found = ask(spark, [(str(p), str(q)) for p, q in pairs], "ab", B.digits(B.add(x, y)), B.digits(B.multiply(x, y)), B.digits(B.subtract(big, small)), B.less(x, y), F.when(b != "0", B.digits(B.modulo(x, y))))
    assert [tuple(r) for r in found] == [(str(p + q), str(p * q), str(abs(p - q)), p < q, str(p % q) if q else None) for p, q in pairs]


def test_expressions_of_ten_thousand_digits(spark):
    rng = random.Random(22)
    n, m = rng.randrange(10**9_999, 10**10_000), rng.randrange(10**9_999, 10**10_000)
    cases = {f"{n} + -{m}": n - m, f"-{n}*{m} ": -n * m, f"{n} ^ {m}": None, f"fib({m})": None, f"{m}!": None, f"{n}^1": n, f"7 ^ {'0' * 50}3": 343}
    e = F.col("e")
    found = ask(spark, [(s,) for s in cases], "s", e["family"].alias("family"), digital.exact_value(e).alias("v"), *(digital.residue(e, k).alias(f"r{k}") for k in (7, 101, 2_147_483_647)))
    for (s, v), r in zip(cases.items(), found):
        assert r["v"] == (None if v is None else str(v))
        if v is not None:
            assert [r["r7"], r["r101"], r["r2147483647"]] == [v % 7, v % 101, v % 2_147_483_647]
    assert found[2]["r2147483647"] == pow(n, m, 2_147_483_647) and found[4]["r101"] == 0
    pisano, at = 50, m % 50  # of 101
    fib = [0, 1]
    while len(fib) < pisano:
        fib.append((fib[-1] + fib[-2]) % 101)
    assert found[3]["r101"] == fib[at]


def test_exact_values_and_any_modulus(spark):
    fib = [0, 1]
    while len(fib) < 2_001:
        fib.append(fib[-1] + fib[-2])
    cases = {"fib(0)": 0, "fib(1)": 1, "fib(2000)": fib[2000], "0!": 1, "500!": factorial(500), "-3^301": -(3**301), "-3^300": 3**300, "0^0": 1, "-1^999999999999999999999": -1, "1^99999999999999999999": 1, "0 * 5": 0, "-2*-3*-0": 0, "5+-5": 0, "123456789012345678901234567890 * 3": 370370367037037036703703703670, "-9 + 4": -5, "12345678901234567890^500": 12345678901234567890**500}
    e = F.col("e")
    assert [r[0] for r in ask(spark, [(s,) for s in cases], "s", digital.exact_value(e))] == [str(v) for v in cases.values()]
    big = 99999999999999999999
    moduli = {f"{s} mod {k}": str(v % k) for s, v in cases.items() for k in (2, 97, 10**9 + 7, big)}
    assert [r[0] for r in ask(spark, [(s,) for s in moduli], "s", digital.answer(e, F.col("v")))] == list(moduli.values())
    claims = [(s, str(v), str(v + 1), str(v + prod((7, 9, 11, 13, 37, 101)))) for s, v in cases.items()]
    for r in ask(spark, claims, "srwm", *(digital.verdict(e, F.col(c)) for c in "rwm")):
        assert tuple(r) == ("NOT_RULED_OUT", "RULED_OUT_WRONG", "NOT_RULED_OUT")


def test_bad_rows_are_null_and_fail_nothing(spark):
    texts = ["", None, "x", "9" * 30, "2^^3", "1+", "*3", "3 mod 5", "2^3 mod 0", "2^3 mod " + "0" * 30, "2^3 mod 1", "fib(-1)", "-3!", "4^-2", "1+2*3x"]
    e = F.col("e")
    assert all(r[0] is None and r[1] is None for r in ask(spark, [(s,) for s in texts], "s", e, digital.answer(e, F.col("v"))))
    assert ask(spark, [("99999999! mod 100000007",)], "s", digital.answer(e, F.col("v")))[0][0] is None


def test_values_of_tables_are_made_in_arrow_batches(spark, sf_dir):
    """Limb by limb a product of 1,000 digits costs some 20,000 interpreted steps; tables of any file size are dealt to tasks before they are parsed."""
    for name in ("expanded_expressions", "thousand_digits"):
        plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "ArrowEvalPython" in plan and "zip_with" not in plan
        assert plan.rindex("RepartitionByExpression") > plan.rindex("regexp_replace")


def test_sums_and_products_of_strings(spark):
    rows = [("7 -9", "-2", "-63"), ("-5 5", "0", "-25"), ("-0 3", "3", "0"), ("", "0", "1"), (None, None, None), ("8", "8", "8")]
    values = F.split(F.nullif(F.col("s"), F.lit("")), " ")
    df = spark.createDataFrame(rows, "s string, total string, product string").select("*", F.when(F.col("s") == "", F.array().cast("array<string>")).otherwise(values).alias("v"))
    assert all(tuple(r) == tuple(r)[:2] * 2 for r in df.select("total", "product", B.total("v"), B.product("v")).collect())


def test_verdicts_of_factorials_between_moduli_and_their_product(spark):
    """The bank's product must not make a factorial run over more factors than its greatest modulus has."""
    e, c = F.col("e"), F.col("c")
    df = spark.createDataFrame([("7000000!", "0"), ("7000000!", "1"), ("fib(90)", "2880067194370816120")], "s string, c string").select(digital.parse(F.col("s")).alias("e"), "c")
    assert [r[0] for r in df.select(digital.verdict(e, c)).collect()] == ["NOT_RULED_OUT", "RULED_OUT_WRONG", "NOT_RULED_OUT"]
