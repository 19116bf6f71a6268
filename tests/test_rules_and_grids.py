"""Rule tables, training grids, loss curves and the ledger against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from sievemark.functions import contracts
from sievemark.operators import bayes, grids, rules
from sievemark.streaming import ledger


def plain_role(text, table, default, exceptions):
    found = next((r.role for r in table if ((text or "").startswith(r.pattern) if r.kind == "starts" else r.pattern.lower() in (text or "").lower())), default)
    words, other = exceptions.get(found, ((), None))
    return other if any(w in (text or "").lower() for w in words) else found


def test_first_rules_are_those_of_a_loop(spark):
    rng = random.Random(51)
    parts = ["ab", "a", "b.", "ba", "(x)", "A b", "c|d", "\\", "aba", "é"]
    table = [rules.Rule(rng.choice(["starts", "contains", "contains"]), "".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))), f"R{rng.randrange(6)}") for _ in range(150)]
    texts = ["".join(rng.choice([*parts, " ", "z"]) for _ in range(rng.randrange(9))) for _ in range(800)] + ["", None]
    exceptions = {"R1": (("z",), "R9"), "R2": (("a b", "é"), "R8")}
    df = spark.createDataFrame(list(enumerate(texts)), "id long, s string").select("id", rules.role_of(F.col("s"), table, "NONE", exceptions).alias("r"))
    found = dict(map(tuple, df.collect()))
    assert [found[i] for i in range(len(texts))] == [plain_role(t, table, "NONE", exceptions) for t in texts]
    with pytest.raises(ValueError, match="no such rule"):
        rules.first_rule(F.lit("x"), [rules.Rule("ends", "x", "R")])


def test_rules_with_their_test_rows(spark):
    table = [rules.Rule("starts", "# ", "BACKGROUND"), rules.Rule("contains", "is defined as", "DEFINE"), rules.Rule("contains", "we propose", "METHOD"), rules.Rule("contains", "future work", "NEXT_STEP")]
    rows = {"# Title we propose": "BACKGROUND", "X IS DEFINED AS y": "DEFINE", "Here we propose a map": "METHOD", "Future work: more": "NEXT_STEP", "Future work; data insufficient": "LIMITATION", "": "CLAIM", None: "CLAIM"}
    df = spark.createDataFrame([(t,) for t in rows], "s string").withColumn("role", rules.role_of(F.col("s"), table, "CLAIM", {"NEXT_STEP": (("insufficient",), "LIMITATION")}))
    found = {r["s"]: (r["role"], *r["i"]) for r in df.withColumn("i", rules.inferred(F.col("role"), F.col("s"), ("not ",), F.col("s").startswith("# "))).collect()}
    assert {t: x[0] for t, x in found.items()} == rows
    assert found["Here we propose a map"][1:] == ("ACTIVE", "maps_to", "YES") and found["# Title we propose"][3] == "NO" and found["Future work; data insufficient"][1:] == ("LIMITED", "warns_about", "YES")
    assert set(rules.STATUS) == set(rules.RELATION) == set(contracts.ROLES) and set(rules.STATUS.values()) <= set(contracts.STATUSES) and set(rules.RELATION.values()) <= set(contracts.RELATIONS)


def test_the_grid_is_one_model_a_setting(spark):
    rng = random.Random(52)
    rows = [(i, i % 4, rng.choice("xyz"), [rng.choice("abcdefgh"[: rng.randrange(2, 9)]) for _ in range(rng.randrange(12))]) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, split long, role string, ts array<string>").cache()
    settings, tests = [("s1", 0), ("s2", 0), ("s2", 1)], [("t1", 2), ("t2", 2), ("t2", 3)]
    found = {}
    for r in grids.grid_predictions(df, "id", "split", "role", "ts", spark.createDataFrame(settings, "setting string, split long"), spark.createDataFrame(tests, "test string, split long")).collect():
        found.setdefault((r["setting"], r["test"]), {})[r["key"]] = r["predicted"]
    for setting in ("s1", "s2"):
        model = bayes.fit(df.filter(F.col("split").isin([s for n, s in settings if n == setting])), "role", "ts")
        for test in ("t1", "t2"):
            asked = df.filter(F.col("split").isin([s for n, s in tests if n == test]))
            assert found[setting, test] == {r["id"]: r["role"] for r in bayes.predict(model, asked, "id", "ts").collect()}


def test_curves_and_drops_are_those_of_a_sweep(spark):
    rng = random.Random(53)
    rows = [(i, rng.randrange(6) / 7, rng.randrange(3), rng.random() < 0.3) for i in range(301)]
    df = spark.createDataFrame(rows, "place long, score double, class int, needed boolean")
    wanted = sum(r[3] for r in rows)
    for r in grids.loss_curve(df, F.col("score"), F.col("needed")).collect():
        kept = [x for x in rows if round(x[1], 6) >= r["threshold"]]
        assert r["token_reduction"] == pytest.approx(1 - len(kept) / len(rows)) and r["recall"] == pytest.approx(sum(x[3] for x in kept) / wanted)
    assert {r["recall"] for r in grids.loss_curve(df, F.col("score"), F.lit(False)).collect()} == {1.0}
    order = sorted(rows, key=lambda x: (x[1], x[2], x[0]))
    for share in (0, 0.001, 0.1, 0.4317, 0.5, 1):
        n = round(len(rows) * share)
        assert grids.ordered_drop(df, ["score", "class"], "place", "needed", share) == (pytest.approx(n / len(rows)), pytest.approx(sum(x[3] for x in order[n:]) / wanted))
    assert grids.ordered_drop(df.limit(0), ["score"], "place", "needed", 0.5) == (0.0, 1.0)


def test_a_stream_stopped_in_the_middle_writes_what_a_batch_does(spark, tmp_path):
    source, schema = tmp_path / "in", "decision_id string, at long, verdict string"
    source.mkdir()

    def error(df):
        return df.withColumn("error", F.when(~F.col("verdict").isin("accept", "reject"), F.concat(F.lit("verdict is "), "verdict")))

    parts = [[("a", 1, "accept"), ("b", 2, "maybe"), ("a", 0, "reject"), (None, 3, "accept")], [("c", 4, "accept"), ("a", 5, "accept")], [("c", 1, "reject"), ("b", 6, "accept"), ("d", 7, "reject")]]
    path, failing = str(tmp_path / "out"), {"on": False}

    def write_then_fail(batch, batch_id):
        ledger.write_batch(batch, batch_id, path, "decision_id", error, ["at"])
        if failing["on"]:
            raise RuntimeError("lost after the write")

    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(source))
        stream = spark.readStream.schema(schema).json(str(source))
        failing["on"] = i == 1
        query = stream.writeStream.foreachBatch(write_then_fail).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
        if failing["on"]:
            with pytest.raises(Exception, match="lost after the write"):
                query.awaitTermination()
            failing["on"] = False
            ledger.record_stream(stream, path, "decision_id", error, ["at"]).awaitTermination()
        else:
            query.awaitTermination()
    found = sorted(map(tuple, ledger.records(spark, path).select("decision_id", "at", "verdict").collect()))
    assert found == [("a", 0, "reject"), ("b", 6, "accept"), ("c", 4, "accept"), ("d", 7, "reject")]
    refused = sorted((r["at"], r["error"]) for r in ledger.records(spark, path, "refused").collect())
    assert refused == [(2, "verdict is maybe"), (3, "decision_id is missing")]
