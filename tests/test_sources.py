"""Scans, sinks, streams and soft matching on small files."""

import hashlib
from itertools import product

from pyspark.sql import functions as F

from sievemark.operators import matching
from sievemark.sources import files
from sievemark.streaming import audit


def test_csv_and_defaults(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n1,"two\nlines, one ""cell"""\n2,\n', encoding="utf-8-sig")
    rows = files.csv_rows(spark, str(tmp_path / "a.csv"))
    assert [tuple(r) for r in rows.orderBy("id").collect()] == [("1", 'two\nlines, one "cell"'), ("2", "")]
    both = files.union_with_defaults([rows, rows.withColumn("score", F.lit(0.5))], {"score": 0.0})
    assert sorted(r["score"] for r in both.collect()) == [0.0, 0.0, 0.5, 0.5]
    files.write_csv(rows, str(tmp_path / "out"), ["text", "id"])
    assert files.csv_rows(spark, str(tmp_path / "out")).columns == ["text", "id"]


def test_json_lines_keep_bad_ones_and_last_wins(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "v": 1}\nnot json\n{"id": 1, "v": 2}\n')
    schema = spark.createDataFrame([], "id long, v long").schema
    rows = files.json_lines(spark, str(tmp_path / "a.jsonl"), schema).cache()
    assert [r["bad_line"] for r in rows.filter("bad_line IS NOT NULL").collect()] == ["not json"]
    assert [tuple(r) for r in files.last_line_wins(rows.select("id", "v"), "id", F.col("v")).collect()] == [(1, 2)]
    bad = files.append_json(rows.select("id", "v"), str(tmp_path / "log"), ["id"])
    assert bad.count() == 1 and spark.read.json(str(tmp_path / "log")).count() == 2


def test_documents_manifest_and_metrics(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.txt").write_text("one\ntwo")
    (tmp_path / "docs/b.md").write_text("| metric | value |\n|---|---|\n| recall | 0.75 |\n")
    assert {r["doc_id"]: r["text"] for r in files.documents(spark, str(tmp_path / "docs")).collect()}["a"] == "one\ntwo"
    listed = spark.createDataFrame([("a.txt", hashlib.sha256(b"one\ntwo").hexdigest()), ("b.md", "0"), ("c.md", "0")], "name string, sha256 string")
    assert {tuple(r) for r in files.changed_files(spark, str(tmp_path / "docs"), listed).collect()} == {("b.md", "changed"), ("c.md", "missing")}
    assert [tuple(r) for r in files.markdown_metrics(spark, str(tmp_path / "docs/b.md")).collect()] == [("recall", 0.75)]


def test_streamed_counts_equal_the_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "event_type").orderBy("ts").limit(300)
    events.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("counts", audit.windowed_counts(stream, "ts", ["event_type"]), "complete"), ("firsts", audit.first_writes(stream, "ts", "event_id"), "append")):
        run = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        run.awaitTermination(120)
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 300 and spark.table("firsts").count() == 300


def test_greedy_matching_is_the_plain_one(spark):
    def likeness(a, b):
        rows = [list(range(len(b) + 1))]
        for i, x in enumerate(a):
            rows.append([i + 1])
            for j, y in enumerate(b):
                rows[-1].append(min(rows[-2][j + 1] + 1, rows[-1][j] + 1, rows[-2][j] + (x != y)))
        return round(1 - rows[-1][-1] / max(len(a), len(b), 1), 9)

    cases = [(["blue", "green", "blue"], ["bluet", "grey", "blue"]), ([], ["a"]), (["abc", "abd"], ["abx", "aby"])]
    df = spark.createDataFrame(cases, "g array<string>, p array<string>")
    for (g, p), r in zip(cases, df.select(matching.greedy_matches(F.col("g"), F.col("p"), 0.4).alias("m")).collect()):
        taken = []
        for score, i, j in sorted((-likeness(g[i], p[j]), i, j) for i, j in product(range(len(g)), range(len(p)))):
            if -score >= 0.4 and all(i != a and j != b for a, b in taken):
                taken.append((i, j))
        assert [(x["g"], x["p"]) for x in r["m"]] == taken
