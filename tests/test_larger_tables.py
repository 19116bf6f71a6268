"""Queries whose work must grow with their tables, not with pairs of rows."""

import pytest

from sievemark.plans import registry


def run(name, spark, path, **tables):
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{table}.parquet")
    return registry.queries()[name](spark, str(path))


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_fallback_candidates_are_cut_before_the_join(spark, tmp_path):
    parts = [(i, 1 + i % 50, None if i % 9 == 0 else 900.0 + i % 200) for i in range(600)]
    suppliers = [(i, i % 27) for i in range(60)]
    found = run("candidates_with_fallback", spark, tmp_path, part=(parts, "p_partkey long, p_size int, p_retailprice double"), supplier=(suppliers, "s_suppkey long, s_nationkey int"))
    wanted = set()
    for s, nation in suppliers:
        c = [(p, size, False if size % 5 != s % 5 else None if price is None else price > 1000) for p, size, price in parts if size % 25 == nation]
        c = [x for x in c if x[2]] or c
        wanted |= {(s, *x) for x in sorted(c, key=lambda x: (-x[1], x[0]))[:3]}
    assert {tuple(r) for r in found.collect()} == wanted
    plan = plan_of(found)
    # Every way from a part to a join leads through a limit of its group.
    assert plan.count("WindowGroupLimit") >= 3


@pytest.mark.parametrize("name, most", [("centroid_fold_predictions", 0), ("naive_bayes_folds", 0), ("naive_bayes_fold_margins", 0), ("tfidf_top_k", 2)])
def test_texts_are_cut_into_terms_once(name, most, spark, sf_dir):
    """What follows the count reads written terms; tfidf_top_k cuts its few questions again."""
    assert plan_of(registry.queries()[name](spark, sf_dir)).count("Generate ") <= most


@pytest.mark.parametrize("name", ["keyword_top_k", "retrieval_scores_of_all", "tfidf_top_k"])
def test_no_task_ranks_all_documents_of_a_question(name, spark, sf_dir):
    assert "WindowGroupLimit" in plan_of(registry.queries()[name](spark, sf_dir))


@pytest.mark.parametrize("name", ["exact_cosine_top_k", "projected_recall_at_ten", "projected_route_search", "quantised_search", "quantised_recall"])
def test_searches_are_dealt_to_many_tasks_in_blocks(name, spark, sf_dir):
    """No join of single rows by pairs, and none on one key for all."""
    plan = plan_of(registry.queries()[name](spark, sf_dir))
    assert "bucket" in plan and "Join Inner, NOT" not in plan and "cosine" not in plan


def test_windows_of_words_are_counted_in_their_task(spark, sf_dir):
    plan = plan_of(registry.queries()["document_chunks"](spark, sf_dir))
    assert "Aggregate" not in plan and "Window" not in plan


def test_covered_names_are_told_by_one_grouping(spark, sf_dir):
    """No join from a word to all phrases that begin with it."""
    plan = plan_of(registry.queries()["dictionary_names"](spark, sf_dir))
    assert "LeftAnti" not in plan and "LeftSemi" not in plan and plan.count("Aggregate") == 1


def test_drops_of_several_shares_are_those_of_sorted_rows(spark):
    from sievemark.operators import grids

    data = [(i % 3, (i * 7) % 100, i % 4 == 0) for i in range(100)]
    shares = [0.0, 0.1, 0.33, 0.5, 0.9, 1.0]
    found = grids.ordered_drops(spark.createDataFrame(data, "rare long, place long, needed boolean"), ["rare"], "place", "needed", shares)
    for share, (reduction, recall) in zip(shares, found):
        n = round(len(data) * share)
        assert (reduction, round(recall, 9)) == (n / 100, round(1 - sum(x[2] for x in sorted(data)[:n]) / 25, 9))


def test_scores_of_the_grid_are_made_once_for_all_tests(spark):
    from sievemark.operators import grids

    rows = spark.createDataFrame([(i, i % 3, "ab"[i % 2], ["x", "yz"[i % 2]]) for i in range(12)], "key long, split long, role string, ts array<string>")
    frame = lambda name, pairs: spark.createDataFrame(pairs, f"{name} string, split long")
    found = grids.grid_predictions(rows, "key", "split", "role", "ts", frame("setting", [("one", 0), ("two", 0), ("two", 1)]), frame("test", [("near", 1), ("far", 2), ("both", 1), ("both", 2)]))
    assert not [x for x in plan_of(found).splitlines() if "Aggregate" in x and "test#" in x]
    assert {(r["test"], r["key"]) for r in found.collect()} == {(t, i) for i in range(12) for t in ("near", "far", "both") if i % 3 in {"near": (1,), "far": (2,), "both": (1, 2)}[t]}


def test_planes_meet_few_vectors_at_once(spark, monkeypatch):
    """The words are the same whatever is held at once."""
    from pyspark.sql import functions as F

    from sievemark.operators import retrieval

    df = spark.createDataFrame([(i, [float((i * j) % 7 - 3) for j in range(8)] if i % 5 else None) for i in range(40)], "id long, v array<float>").coalesce(1)
    words = lambda: sorted((r[0], r[1]) for r in df.select("id", retrieval.projected_words(F.col("v"), 4, 6)).collect())
    whole = words()
    monkeypatch.setattr(retrieval, "PLANE_ROWS", 3)
    assert words() == whole and whole[0][1] is None


@pytest.mark.parametrize("name", ["contextual_routing", "route_summaries", "element_routing"])
def test_tokens_of_turns_are_never_shuffled(name, spark, sf_dir):
    """From the result down to where texts are cut into tokens there is no exchange by keys."""
    plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan[: plan.index("Generate explode")]


@pytest.mark.parametrize("name", ["contextual_routing", "route_summaries", "element_routing", "token_priors"])
def test_rare_words_up_to_the_cutoff_are_low(name, spark, tmp_path):
    """The cutoff lies among words of under an eighth of the turns, which are looked up only where a turn repeats them."""
    import duckdb

    word = lambda n: "".join("abcdefghij"[int(d)] for d in f"{n:04d}")
    # Words 0 to 79 in three turns each, words from 1000 on in one each; some repeated, some names, some asked by the turn before.
    text = lambda i: f"The {word(i % 80)} and {word((i + 20) % 80)}s {word((i + 40) % 80).title()} {word((i + 40) % 80).title()}! {word(i % 80)} {word(1000 + i)} not 7 {word(2000 + i)}, {word(1000 + i)}\n{word((i + 20) % 80)} [3] of the."
    turns = [(i // 4, i % 4, "user", text(i // 2 if i % 5 == 0 else i)) for i in range(120)] + [(40, 0, "user", None), (40, 1, "user", ""), (None, 0, "user", "Wo Wo no."), (41, None, "user", word(3) + " " + word(3).title())]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    found = registry.queries()[name](spark, str(tmp_path))
    asked = con.execute(f"SELECT {', '.join(found.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    plain = lambda rows: sorted((tuple(round(x, 6) + 0.0 if isinstance(x, float) else x for x in map(lambda v: float(v) if type(v).__name__ == "Decimal" else v, r)) for r in rows), key=repr)
    assert plain(map(tuple, found.collect())) == plain(asked)
    if name == "contextual_routing":
        assert {r["low_information"] for r in found.select("low_information").distinct().collect()} == {False, True}


def test_elements_of_listed_words_come_from_one_map(spark):
    """The first element that lists a word, without a chain of two dozen lists."""
    from pyspark.sql import functions as F

    from sievemark.functions import elements as E

    words = sorted({w for ws in E.ELEMENT_WORDS.values() for w in ws.split()} - set(E.CODE) - set(E.UNITS))
    found = spark.createDataFrame([(w,) for w in words], "k string").select("k", E.element(F.col("k")).alias("e"))
    assert {r[0]: r[1] for r in found.collect()} == {w: next(label for label, ws in E.ELEMENT_WORDS.items() if w in ws.split()) for w in words}
    plan = plan_of(spark.range(1).select(E.element(F.col("id").cast("string"))))
    assert plan.count(" INSET ") + plan.count(" IN (") <= 4


def test_terms_of_documents_meet_questions_where_they_lie(spark, tmp_path, monkeypatch):
    """Whatever goes to the texts at once; rows that repeat an id, or have none, and empty texts are as in the SQL."""
    import random

    import duckdb

    from sievemark.operators import retrieval

    for name, value in (("HOT_TERMS", 7), ("ASKED_ROWS", 30), ("ASKED_KEYS", 3), ("CELLS", 1), ("TEXT_ROWS", 4)):
        monkeypatch.setattr(retrieval, name, value)
    rng = random.Random(3)
    text = lambda n: " ".join(f"w{int(40 * rng.random() ** 3)}" for _ in range(n))
    docs = [(rng.choice([None, 1, 2, 3, *range(10, 90)]), text(rng.randrange(20))) for _ in range(120)] + [(200, None), (201, ""), (202, "x y z"), (203, "w1 w2"), (204, "W1, w2")]
    items = [(i, text(6)) for i in range(10)] + [(None, "w1"), (20, ""), (21, None), (3, "w1 w5 w5"), (22, "unheard")]
    run("tfidf_top_k", spark, tmp_path, documents=(docs, "doc_id long, text string"), benchmark=(items, "item_id long, text string"))
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    found = registry.queries()["tfidf_top_k"](spark, str(tmp_path))
    asked = con.execute(f"SELECT {', '.join(found.columns)} FROM ({registry.oracle_sql()['tfidf_top_k']})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(asked)
    # Pairs of documents and questions are no rows that an exchange deals out: only the last ranking is dealt by questions.
    plan = plan_of(found)
    assert "Aggregate" not in plan and "Generate" not in plan
