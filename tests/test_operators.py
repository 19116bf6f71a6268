"""Operators on small cases by hand: guards, cells, expressions, validators, grounding, control."""

import difflib
import random
from math import comb, factorial

import pytest
from pyspark.sql import functions as F

from sievemark.functions import cells, digital, elements, extraction, grounding, predicates, text
from sievemark.operators import control, summaries, tables
from sievemark.plans import registry
from sievemark.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_join_guards(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string"), spark.createDataFrame([(1, 0.5)], "k long, w double")
    assert tables.unique(a, "k").count() == 2
    with pytest.raises(ValueError, match="repeated"):
        tables.unique(a.union(a), "k")
    with pytest.raises(KeyError):
        tables.join_required(a, b, "k")
    assert tables.join_required(a.filter("k = 1"), b, "k").count() == 1


def test_singular(spark):
    assert [one(spark, text.singular(F.lit(w))) for w in ("(Cats)", "glass", "gas", "'runs'")] == ["cat", "glass", "gas", "run"]


def test_tokens_classes_and_elements(spark):
    got = one(spark, elements.tokens(F.lit("Schön don't [3] https://a.b/c F(118) x >= 5% \"q\"\nNext")))
    assert got == ["Sch", "n", "don", "'", "t", "[3]", "https://a.b/c", "F", "(", "118", ")", "x", ">", "=", "5", "%", '"', "q", '"', "\nNext"]
    pairs = {"return": ("code_token", "CODE"), "%": ("punctuation", "BOUNDARY"), "[3]": ("citation", "CITATION"), "1999": ("number", "DATE"), "118": ("number", "NUMBER"), "required": ("content_word", "MODAL"), "according": ("content_word", "SUPPORT"), "not": ("negation", "NEGATION"), "f(3)": ("formula", "FORMULA"), "London": ("named_entity", "ENTITY"), "walking": ("content_word", "ACTION"), "ms": ("content_word", "UNIT")}
    for token, (kind, element) in pairs.items():
        assert (one(spark, elements.token_class(F.lit(token))), one(spark, elements.element(F.lit(token)))) == (kind, element), token


def test_codons(spark):
    value = lambda *e: one(spark, elements.codon_value(*map(F.lit, e)))
    assert value("NEGATION", "FUNCTION", "BOUNDARY") == 0.12 and value("FUNCTION", "BOUNDARY", "CONNECTOR") == 0.05
    assert value("MODAL", "ACTION", "FUNCTION") == 0.92 and value("THRESHOLD", "NUMBER", "UNIT") == 0.90 and value("DEFINE", "CONCEPT", "RISK") == 0.88
    assert value("CONCEPT", "ENTITY", "FUNCTION") == 0.66 and value("CONCEPT", "CONCEPT", "FUNCTION") == 0.5 and value("UNKNOWN", "UNKNOWN", "UNKNOWN") == 0.3


def test_expressions_against_big_integers(spark):
    rng, fib = random.Random(2), [0, 1]
    while len(fib) < 400:
        fib.append(fib[-1] + fib[-2])
    cases = [(f"{b} ^ {e}", b**e) for b, e in ((2, 100), (-7, 33), (99, 0))] + [(f"fib({n})", fib[n]) for n in (0, 1, 2, 90, 399)] + [(f"{n}!", factorial(n)) for n in (0, 1, 20, 60)]
    cases += [("3*-4*5000000000", -60_000_000_000), ("7 + -9+12", 10)]
    df = spark.createDataFrame([(s, str(v), str(v + 33_666_633), str(v + rng.randrange(1, 10**6))) for s, v in cases], "s string, right string, missed string, wrong string")
    e = digital.parse(F.col("s"))
    for (s, v), r in zip(cases, df.select("s", *(digital.residue(e, m).alias(f"r{m}") for m in (2, 101, 2_147_483_647)), *(digital.verdict(e, F.col(c)).alias(c) for c in ("right", "missed", "wrong"))).collect()):
        assert [r["r2"], r["r101"], r["r2147483647"]] == [v % 2, v % 101, v % 2_147_483_647], s
        assert (r["right"], r["missed"], r["wrong"]) == ("NOT_RULED_OUT", "NOT_RULED_OUT", "RULED_OUT_WRONG"), s
    assert [one(spark, digital.parse(F.lit(x))) for x in ("", "2^", "a+b", "5 mod 1", "2^3 mod 1", "1**x")] == [None] * 6
    assert one(spark, digital.parse(F.lit("2 ** 5  MOD 7")))["modulus"] == 7


def test_long_decimal_strings(spark):
    rng = random.Random(3)
    values = [rng.randrange(-(10**n), 10**n) for n in (1, 8, 9, 10, 18, 19, 40, 300)]
    df = spark.createDataFrame([(str(v),) for v in values], "s string")
    assert [r[0] for r in df.select(digital.residues(F.col("s"))).collect()] == [[v % m for m in (7, 9, 11, 13, 37, 101)] for v in values]


def test_cycles_and_exact_values(spark):
    for base, m in ((2, 7), (10, 48), (6, 8), (0, 5), (3, 1009)):
        c = one(spark, digital.power_cycle(F.lit(base), F.lit(m)))
        terms = [pow(base, i, m) for i in range(1, 2 * m + 5)]
        mu, lam = next((i, n) for n in range(1, m + 1) for i in range(m + 1) if all(terms[j] == terms[j + n] for j in range(i, m + 2)))
        assert (c["mu"], c["lam"], c["sequence"]) == (mu, lam, terms[: mu + lam])
        assert one(spark, digital.power_by_cycle(F.lit(base), F.lit(123456), F.lit(m))) == pow(base, 123456, m)
    assert [one(spark, digital.pisano_period(F.lit(m))) for m in (2, 3, 10, 101)] == [3, 8, 60, 50]
    assert one(spark, digital.factorial_zeros(F.lit(10**12))) == sum(10**12 // 5**i for i in range(1, 18))
    assert [one(spark, digital.binomial_mod(F.lit(n), F.lit(k), 7)) for n, k in ((50, 3), (49, 7), (10, 11))] == [comb(50, 3) % 7, comb(49, 7) % 7, 0]
    r = one(spark, digital.reconstruct([F.lit(2), F.lit(3)], (5, 7), F.lit(35)))
    assert (r["value"], r["modulus_product"], r["ambiguous"]) == (17, 35, False)
    with pytest.raises(ValueError, match="factor"):
        digital.reconstruct([F.lit(1), F.lit(1)], (4, 6))


def test_cells_of_every_contract(spark):
    assert sorted(one(spark, cells.piped_lower(F.lit("A|b| a ||")))) == ["a", "b"] and one(spark, cells.piped_lower(F.lit(None))) == []
    assert one(spark, cells.list_or_separated(F.lit('["x", " y "]'))) == ["x", "y"] and one(spark, cells.list_or_separated(F.lit("a, b; c"))) == ["a, b", "c"]
    assert one(spark, cells.with_format(F.lit("a\nb")))["format"] == "newline" and one(spark, cells.ordered_distinct(F.lit("b; a; b"))) == ["b", "a"]
    empty = F.array().cast("array<string>")
    assert (one(spark, cells.jaccard(empty, empty, 1.0)), one(spark, cells.jaccard(empty, empty, 0.0))) == (1.0, 0.0)


def test_predicates(spark):
    assert one(spark, predicates.has_phrase(F.lit("We use C++ daily"), "c++")) and not one(spark, predicates.has_phrase(F.lit("catalog"), "cat"))
    assert one(spark, predicates.first_integer(F.lit("so -12 or 7"))) == -12 and one(spark, predicates.first_integer(F.lit(None))) == 0


def test_json_objects_and_code(spark):
    objects = {"x {\"a\": \"}\"} y": '{"a": "}"}', "{no} { \"b\": {}}": '{ "b": {}}', "```json\n{\"c\": 1}\n``` {\"d\": 2}": '{"c": 1}', "none": None, "[1] {\"e\": 1}": '{"e": 1}', "": None}
    assert {k: one(spark, extraction.json_object(F.lit(k))) for k in objects} == objects
    assert one(spark, extraction.code(F.lit("Sure, here:\nx = 2\nExplanation: no"))) == "x = 2" and one(spark, extraction.code(F.lit("nothing here"))) is None


def test_grounding(spark):
    check = lambda a, s, k=None: one(spark, grounding.check(F.lit(a), F.lit(s), k))
    assert check("Berlin had 12 towers [1]", "In 2012 Berlin built towers")["verdict"] == "NOT_RULED_OUT"
    bad = check("Paris had 99 towers", "Berlin built towers")
    assert (bad["verdict"], bad["reason"]) == ("RULED_OUT_WRONG", "missing entities: Paris; missing numbers/dates: 99; missing citation marker")
    assert check("so it is", "x")["verdict"] == "UNCHECKABLE" and check("Berlin, see doc7", "Berlin towers", F.array(F.lit("doc7")))["verdict"] == "NOT_RULED_OUT"


def test_repair_and_traces(spark):
    d = spark.createDataFrame([(1, "arithmetic", "RULED_OUT_WRONG"), (2, "retrieval", "UNCHECKABLE"), (3, "json_schema", "RULED_OUT_WRONG"), (4, "python_code", "RULED_OUT_WRONG")], "decision_id long, task_type string, verdict string")
    a = spark.createDataFrame([(1, 1, "RULED_OUT_WRONG", []), (1, 2, "RULED_OUT_WRONG", []), (1, 3, "NOT_RULED_OUT", []), (3, 1, "NOT_RULED_OUT", ["f"]), (4, 1, "UNCHECKABLE", []), (4, 2, "NOT_RULED_OUT", [])], "decision_id long, attempt int, verdict string, damaged array<string>")
    got = {r["decision_id"]: (r["tried"], r["action"], r["final_status"]) for r in control.repaired(d, a).collect()}
    assert got == {1: (3, "full_compute", "escalated"), 2: (0, "escalate", "escalated"), 3: (1, "repair", "escalated"), 4: (2, "repair", "repaired")}


@pytest.mark.parametrize("sorted_rows", [0, 10**6])
def test_nearest_ranks_are_those_of_sorted_values(spark, sorted_rows, monkeypatch):
    monkeypatch.setattr(summaries, "SORTED_ROWS", sorted_rows)
    rng = random.Random(6)
    values = {g: [rng.choice([rng.random(), 0.5, 7.0]) for _ in range(n)] for g, n in (("a", 1), ("b", 4), ("c", 2_001))}
    rows = [(g, v) for g, vs in values.items() for v in vs] + [(None, 1.0), ("a", None)]
    shares = {"low": 0.0, "mid": 0.5, "high": 0.95, "top": 1.0}
    found = {r["g"]: [r[k] for k in shares] for r in summaries.nearest_ranks(spark.createDataFrame(rows, "g string, v double"), "g", "v", shares).collect()}
    assert found == {g: [sorted(vs)[round((len(vs) - 1) * q)] for q in shares.values()] for g, vs in [*values.items(), (None, [1.0])]}


def test_matching_ratio_is_that_of_the_library(spark, sf_dir):
    names = {r["p_partkey"]: (r["p_name"].lower(), r["p_type"].lower()) for r in spark.read.parquet(f"{sf_dir}/part.parquet").collect()}
    for r in registry.queries()["matching_ratios"](spark, sf_dir).collect():
        assert r["ratio"] == pytest.approx(difflib.SequenceMatcher(None, *names[r["p_partkey"]]).ratio(), abs=1e-6)


def test_reports_and_discovery(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1), (None, 2)], "name string, n long")
    files.write_report(df, str(tmp_path / "report"), "Counts")
    lines = [r[0] for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert lines[0] == "# Counts" and "| a\\|b | 1 |" in lines
    with pytest.raises(ValueError, match="more than"):
        files.write_report(df, str(tmp_path / "none"), "Counts", most=1)
    docs = lambda *rows: spark.createDataFrame(list(rows), "path string, doc_id string, text string")
    found = files.discovered([docs(("p1", "a", " ")), docs(("q2", "b", "two"), ("q1", "b", "one"))], docs(("f", "f", "fall")))
    assert [tuple(r) for r in found.collect()] == [("q1", "b", "one")]
    (tmp_path / "l.jsonl").write_text('{"id": 1}\n\nbroken\n{"id": 2}\n')
    got = files.numbered_lines(spark, str(tmp_path / "l.jsonl"), spark.createDataFrame([], "id long").schema).orderBy("line_number").collect()
    assert [(r["line_number"], r["id"], r["bad_line"]) for r in got] == [(1, 1, None), (3, None, "broken"), (4, 2, None)]
    (tmp_path / "m.md").write_text("| acc | 0.5 |\n")
    assert files.markdown_metrics(spark, str(tmp_path / "m.md"), ("acc",)).count() == 1
    with pytest.raises(ValueError, match="lost"):
        files.markdown_metrics(spark, str(tmp_path / "m.md"), ("lost",))
