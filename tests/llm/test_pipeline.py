"""The pipeline's stages on awkward tables, and the whole of it against plain Python."""

import importlib.util

import pytest
from pyspark.sql import functions as F

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("no pipeline", allow_module_level=True)

import corpus_pipeline as C

STAGES = dict(C.STAGES)
FILTERS = [n for n, _ in C.STAGES[:-1]]


@pytest.mark.parametrize("name", FILTERS)
def test_stages_keep_columns_and_take_empty_tables(name, spark, sf_dir, empty):
    found = STAGES[name](spark, empty, sf_dir)
    assert found.columns == empty.columns and found.count() == 0


def test_packing_takes_empty_tables(spark, sf_dir, empty):
    assert C.packing_stage(spark, empty, sf_dir).count() == 0


@pytest.fixture(scope="module")
def rough(spark, loose):
    """Fine and junk texts, null ids and texts, repeated rows, two texts under one id; helper names as columns."""
    from conftest import SCHEMA

    fine = " ".join(f"plain{i % 37} word{i} stands here and there." for i in range(40))
    rows = [(1, fine, "en", "a", 1), (1, fine, "en", "a", 1), (2, fine + " more", "en", "b", 1), (3, "Zx9Qw2Er7Ty4Ui1Op5As8Df3Gh6 " + fine[::-1], "en", "b", 1), (3, fine.upper()[::-1].lower() + " tail end", "en", "c", 1)]
    rows += [(None, fine, "en", "a", 1), (None, fine, "en", "a", 1), (4, None, "en", "a", 9), (5, "", None, None, 9), (6, "! " * 90, "en", "a", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in set(loose.columns) - set(df.columns) | {"mask_spans", "mask_row", "doc", "shingles", "whole", "pattern", "rep", "text_"}:
        df = df.withColumn(c, F.lit(77))
    return df.cache()


@pytest.mark.parametrize("name", FILTERS)
def test_other_columns_come_through_unchanged(name, spark, sf_dir, rough):
    found = STAGES[name](spark, rough, sf_dir)
    assert found.schema.names == rough.schema.names
    rows = found.collect()
    extra = [c for c in rough.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
    assert rows and all(r[c] == 77 for r in rows for c in extra)


def ids(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in df.select("doc_id").collect())


def test_repeated_rows_stay_or_go_together(spark, sf_dir, rough):
    for name in ("quality_classifier", "quality_rules"):
        found = STAGES[name](spark, rough, sf_dir)
        kept = {(r["doc_id"], r["text"]) for r in found.collect()}
        assert found.count() == sum((r["doc_id"], r["text"]) in kept for r in rough.collect())
    assert not {4, 5} & {r["doc_id"] for r in C.quality_rules_stage(spark, rough, sf_dir).collect()}


def test_near_duplicates_lose_no_text(spark, sf_dir, rough):
    found = C.near_dedup_stage(spark, rough, sf_dir)
    assert ids(found) == sorted([(False, 1), (False, 3), (False, 3), (False, 4), (False, 5), (False, 6), (True, 0), (True, 0)])


def test_masking_keeps_every_row(spark, sf_dir, rough):
    found = C.secret_scan_stage(spark, rough, sf_dir)
    assert ids(found) == ids(rough)
    for r in found.collect():
        assert "Zx9Qw2Er7Ty4Ui1Op5As8Df3Gh6" not in (r["text"] or "")
        assert r["n_chars"] == (9 if r["text"] is None else len(r["text"]))


def test_run_is_the_stages_one_after_another(spark, sf_dir, documents):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    docs = documents
    for name in FILTERS:
        docs = spark.createDataFrame(STAGES[name](spark, docs, sf_dir).collect(), documents.schema)
    left = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = {d: len(tok.encode(t, add_special_tokens=False).ids) + 1 for d, t in left.items()}
    rows, got, room = C.run(spark, sf_dir).collect(), {}, {}
    for r in rows:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
        room[r["sequence_id"]] = room.get(r["sequence_id"], 0) + r["length"]
    assert got == want and max(room.values()) <= 4096 and sum(room.values()) / (4096 * len(room)) > 0.8
