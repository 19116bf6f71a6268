"""The projected index against brute force."""

import numpy as np
import pytest

from sievemark.plans import registry


def nearest(spark, sf_dir):
    """vec_id -> the set of the true ten by cosine, of every fiftieth vector."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = {}
    for i in np.flatnonzero(ids % 50 == 0):
        score = x @ x[i]
        score[i] = -9
        found[int(ids[i])] = {int(v) for v in ids[np.argsort(-score)[:10]]}
    return found


def test_projected_index_finds_nine_tenths_of_the_true_nearest(spark, sf_dir):
    true = nearest(spark, sf_dir)
    got = {}
    for r in registry.queries()["projected_route_search"](spark, sf_dir).collect():
        got.setdefault(r["q"], set()).add(r["vec_id"])
    assert np.mean([len(true[q] & got.get(q, set())) / 10 for q in true]) >= 0.9
    told = {r["q"]: r["recall"] for r in registry.queries()["projected_recall_at_ten"](spark, sf_dir).collect()}
    assert told == {q: pytest.approx(len(true[q] & got.get(q, set())) / 10) for q in true}


def test_projected_codes_keep_nine_tenths_of_the_true_nearest(spark, sf_dir):
    true = nearest(spark, sf_dir)
    got = {}
    for r in registry.queries()["projected_simhash_neighbours"](spark, sf_dir).collect():
        got.setdefault(r["q"], set()).add(r["vec_id"])
    assert np.mean([len(true[q] & got.get(q, set())) / 10 for q in true]) >= 0.9


def test_projected_codes_see_the_second_half_of_a_vector(spark, tmp_path):
    a, b = [1.0] * 64, [1.0] * 32 + [-1.0] * 32
    spark.createDataFrame([(0, a), (1, a), (2, b)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [tuple(r) for r in registry.queries()["projected_simhash_neighbours"](spark, str(tmp_path)).collect()] == [(0, 1, 0)]
