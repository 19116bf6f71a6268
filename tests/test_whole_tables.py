"""Queries that leave no row of their tables out."""

import pytest

from sievemark.functions import text as T
from sievemark.plans import registry


def test_reconciled_outputs_are_all_documents_and_all_labels(spark, tmp_path):
    spark.createDataFrame([(i,) for i in range(9)], "doc_id long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i,) for i in (0, 1, 3, 3, 20, 21)], "doc_id long").write.parquet(f"{tmp_path}/labels.parquet")
    found = {r["doc_id"]: r["status"] for r in registry.queries()["reconcile_all_outputs"](spark, str(tmp_path)).collect()}
    assert found == {i: "matched" if i in (0, 1, 3) else "missing" for i in range(9)} | {20: "unknown", 21: "unknown"}


@pytest.mark.parametrize("name", ["centroid_fold_predictions", "naive_bayes_fold_margins"])
def test_every_labelled_document_is_predicted(name, spark, sf_dir):
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    labelled = documents.join(labels, "doc_id", "left_semi").filter("doc_id IS NOT NULL").select("doc_id", T.terms(documents["text"]).alias("ts")).filter("size(ts) > 0")
    found = [r["doc_id"] for r in registry.queries()[name](spark, sf_dir).collect()]
    assert sorted(found) == sorted(r["doc_id"] for r in labelled.collect())


def test_items_without_a_candidate_count_as_not_found(spark, tmp_path):
    spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "beta gamma"), (2, ""), (3, None), (4, "unheard words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert tuple(registry.queries()["retrieval_scores_of_all"](spark, str(tmp_path)).first()) == (4, 0.25, 0.25, 0.25)


def test_every_vector_is_asked_for_its_neighbours(spark, tmp_path, monkeypatch):
    """Also where tasks hold few queries at once; null ids and null vectors are nobody's neighbours."""
    from sievemark.operators import quantiser

    monkeypatch.setattr(quantiser, "QUERY_ROWS", 3)
    a, b = [1.0] * 64, [1.0] * 32 + [-1.0] * 32
    rows = [(i, a if i % 2 else b) for i in range(1, 9)] + [(None, a), (11, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = registry.queries()["projected_simhash_neighbours"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == [(i, j, 0) for i in range(1, 9) for j in range(1, 9) if i != j and i % 2 == j % 2]
