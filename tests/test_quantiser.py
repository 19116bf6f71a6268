"""The product quantiser, its shortlists and inverted lists against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemark.operators import quantiser as V
from sievemark.plans import registry


def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "id long, v array<float>")


def plain_books(values, parts, codes, begin):
    books = []
    for p, block in enumerate(np.split(values, parts, 1)):
        centres = np.split(begin, parts, 1)[p].copy()
        for _ in range(V.ROUNDS):
            near = ((block[:, None] - centres[None]) ** 2).sum(2).argmin(1)
            for c in range(len(centres)):
                if (near == c).any():
                    centres[c] = np.floor(block[near == c].sum(0) / (near == c).sum())
        books.append(centres)
    return np.stack(books)


def test_training_is_plain_k_means_however_rows_are_dealt(spark):
    rng = np.random.default_rng(4)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(300, 12)))]
    df = vectors(spark, rows)
    begin = V.seeds(df, "id", "v", 9)
    values = np.floor(np.array([v for _, v in rows]).astype(np.float32).astype(float) * V.SCALE + 0.5).astype(np.int64)
    expected = plain_books(values, 4, 9, begin)
    for parts in (1, 7):
        assert np.array_equal(V.train(df.repartition(parts), "id", "v", 4, 9), expected)


def test_nulls_few_vectors_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (None, [1.0, 1.0]), (3, [None, 1.0]), (4, [1.0, 2.5])], "id long, v array<double>")
    books = V.train(df, "id", "v", 2, 16)
    assert books.shape == (2, 2, 1)
    asked = df.select(F.col("id").alias("query"), F.col("v").alias("vector"))
    found = V.quantised_search(df, asked, "id", "v", books, 3).select("query", "id").collect()
    assert sorted(map(tuple, found)) == [(1, 4), (4, 1)]
    nothing = V.train(df.limit(0), "id", "v", 2, 16)
    assert nothing.shape[1] == 0


def test_shortlists_are_the_nearest_codes_in_blocks_of_any_size(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(120, 8)))] + [(500, np.ones(8)), (501, np.ones(8))]
    df = vectors(spark, rows)
    books = V.train(df, "id", "v", 4, 5)
    values = np.floor(np.array([v for _, v in rows]).astype(np.float32).astype(float) * V.SCALE + 0.5).astype(np.int64)
    codes = V.encode(values, books)
    everywhere = F.lit(0).cast("long").alias("group")
    asked = df.filter("id % 50 = 0").select(F.col("id").alias("query"), F.col("v").cast("array<double>").alias("vector"), everywhere)
    for rows_a_block in (7, 4_096):
        monkeypatch.setattr(V, "BLOCK_ROWS", rows_a_block)
        held = V.coded(df, "id", "v", books).withColumn("group", everywhere)
        found = {}
        for r in V.shortlists(held.repartition(5), asked, "id", books, 10).collect():
            found.setdefault(r["query"], []).append((r["distance"], r["id"]))
        for at, (q, _) in enumerate(rows):
            if q % 50 == 0:
                far = []
                for i, (k, _) in enumerate(rows):
                    d = 2 * sum(int(((values[at].reshape(4, 2)[p] - books[p, codes[i, p]]) ** 2).sum()) for p in range(4))
                    far.append((d // 2 if (codes[i] == codes[at]).all() else d, k))
                assert sorted(found[q]) == sorted(x for x in far if x[1] != q)[:10]


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_shortlists_of_the_tables_hold_nine_of_ten_neighbours(folder, spark):
    path = f"/root/testdata/{folder}"
    n = spark.read.parquet(f"{path}/embeddings.parquet").count()
    recall, candidates = registry.queries()["quantised_recall"](spark, path).agg(F.avg("recall"), F.max("candidates")).first()
    assert recall >= 0.9 and candidates <= 0.2 * n


def test_inverted_lists_find_planted_neighbours_in_a_fifth_of_the_vectors(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(100, 32))
    values = np.concatenate([c + rng.normal(scale=0.15, size=(20, 32)) for c in centres])
    df = vectors(spark, list(enumerate(values))).repartition(6).cache()
    lists, books = V.train(df, "id", "v", 1, 64), V.train(df, "id", "v", 16, 16)
    asked = df.filter("id % 50 = 0").select(F.col("id").alias("query"), F.col("v").alias("vector"))
    found = {}
    for r in V.quantised_search(df, asked, "id", "v", books, 10, 8, lists, 3).collect():
        found.setdefault(r["query"], set()).add(r["id"])
    unit = values / np.linalg.norm(values, axis=1, keepdims=True)
    hits = []
    for q in range(0, len(values), 50):
        near = np.argsort(-np.delete(unit @ unit[q], q), kind="stable")[:10]
        hits.append(len(found[q] & {int(i + (i >= q)) for i in near}) / 10)
    read = V._probed(asked.select("query", F.col("vector").cast("array<double>")), lists, 3).join(V.coded(df, "id", "v", lists).select(F.ascii(F.unhex(F.hex("codes"))).cast("long").alias("group")), "group").groupBy("query").count()
    assert np.mean(hits) >= 0.9 and read.agg(F.avg("count")).first()[0] <= 0.2 * len(values)
