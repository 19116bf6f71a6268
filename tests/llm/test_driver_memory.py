"""What the driver must never hold: tables that Spark takes for smaller than they are."""

import pytest

from sievemark.llm import near_dedup


@pytest.mark.parametrize("hot_pairs", [near_dedup.HOT_PAIRS, 0])
def test_keys_of_documents_are_never_broadcast(spark, monkeypatch, hot_pairs):
    """Sixty keys a document stand in no file whose size Spark knows; neither do the shingles of hot keys, nor are a document's own rows sent to all."""
    plans, write = [], near_dedup.materialize
    monkeypatch.setattr(near_dedup, "HOT_PAIRS", hot_pairs)
    monkeypatch.setattr(near_dedup, "materialize", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    words = [f"w{i}" for i in range(200)]
    shift = lambda i, n: words[:i] + ["new"] * n + words[i + n :]
    # Copies, near copies, and texts that share a part only.
    texts = [words, words, *(shift(i, 2) for i in range(0, 150, 15)), *(words[:90] + [f"v{j}_{i}" for i in range(60)] for j in range(8))]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = near_dedup.near_duplicates(docs)
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {i: 0 if i < 12 else i for i in range(20)}
    plans = [p for p in plans if "Generate explode(array(xxhash64" in p or "Generate explode(shingles" in p] + [found._jdf.queryExecution().executedPlan().toString()]
    assert len(plans) >= 2 and not [p for p in plans if "Join" in p and "BroadcastExchange" in p]


def test_the_pipelines_near_dedup_broadcasts_no_keys(spark, monkeypatch):
    import corpus_pipeline

    plans, write = [], near_dedup.materialize
    monkeypatch.setattr(near_dedup, "materialize", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, "some other words that stand alone here")], "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()} == {1, 3}
    plans = [p for p in plans if "Generate explode(array(xxhash64" in p and "Join" in p]
    assert plans and not [p for p in plans if "BroadcastExchange" in p]
