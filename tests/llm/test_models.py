"""Trained operators by held-out accuracy, and every operator on empty tables and loose rows."""

import importlib.util
import math

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest

from sievemark.llm import bpe_codec, fingerprints, language_id, near_dedup, packing, pii, quality_classifier, quality_rules, ragged, secret_scan, token_counts


def test_language_of_held_out_texts(both, texts):
    truth = {r["doc_id"]: r["lang"] for r in both.collect()}
    rows = language_id.identify(both, P.path("piece_bpe_32k.model")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert 0 <= r["score"] <= 1
        if not any(c.isalpha() for c in texts[r["doc_id"]]):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    judged = [r for r in rows if r["held_out"] and r["doc_id"] < 10_000_000 and truth[r["doc_id"]] and r["lang_pred"] != "und"]
    assert judged and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in judged]) > 0.9


def test_forward_algorithm_sums_all_segmentations(monkeypatch):
    path = P.path("piece_bpe_32k.model")
    n = language_id.n_pieces(path)
    p = np.random.default_rng(2).random((n + 1, 1)) / n
    number = {name: i for i, name in enumerate(language_id.pieces(path).names)}
    word = "the"
    marked = chr(language_id.BEGIN) + word

    def prob(piece):
        if piece in number:
            return p[number[piece], 0]
        return p[-1, 0] if len(piece) == 1 else 0.0

    def total(rest):
        return 1.0 if not rest else sum(prob(rest[:k]) * total(rest[k:]) for k in range(1, min(len(rest), language_id.PIECE_CHARS) + 1))

    assert language_id.Lattice([word], path).words(p)[0, 0] == pytest.approx(np.log(total(marked)))


def test_quality_classifier_against_labels(documents, spark, sf_dir):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    found = {r["doc_id"]: r["kept"] for r in quality_classifier.classify(documents).collect() if r["doc_id"] in labels}
    good = [found[d] for d in found if labels[d] == 1]
    assert np.mean(good) > 0.9
    assert np.mean([found[d] == bool(labels[d]) for d in found]) > 0.8


def test_em_recovers_the_accuracies_of_known_labellers():
    rng = np.random.default_rng(3)
    n, k = 50_000, len(quality_classifier.LABELLERS)
    accuracy, speaks = np.linspace(0.7, 0.95, k), np.linspace(0.9, 0.4, k)
    for share in (0.6, 0.8, 0.9):
        fine = rng.random(n) < share
        said = np.where((rng.random((n, k)) < accuracy) == fine[:, None], quality_classifier.FINE, quality_classifier.JUNK)
        said = np.where(rng.random((n, k)) < speaks, said, quality_classifier.NO_VOTE)
        codes, back, counts = np.unique(quality_classifier.packed(said), return_inverse=True, return_counts=True)
        post, table, found = quality_classifier.estimate(codes, counts.astype(float))
        assert found == pytest.approx(share, abs=0.02)
        assert quality_classifier.accuracies(table, found) == pytest.approx(accuracy, abs=0.03)
        assert ((post[back] > 0.5) == fine).mean() > 0.93


def test_labellers_are_told_over_all_documents(documents, empty):
    found = quality_classifier.labellers(documents)
    assert found["labeller"].tolist() == quality_classifier.LABELLERS
    assert ((found["accuracy"] > 0.5) & (found["accuracy"] <= 1)).all() and quality_classifier.labellers(empty).empty


def test_vote_patterns_are_counted_and_scored_as_by_hand(documents, texts):
    """The brute-force version: statistics, votes and EM of every document in one process; scores from the same weights."""
    ids = [d for d in texts if d < 10_000_000]
    ((_, _, data, offsets),) = ragged.slices(pa.array([texts[d] for d in ids]), 1 << 40)
    x = quality_classifier.textstats.features(quality_classifier.textstats.text_counts(data, offsets))
    said = quality_classifier.votes(x)
    codes, back, counts = np.unique(quality_classifier.packed(said), return_inverse=True, return_counts=True)
    post = quality_classifier.estimate(codes, counts.astype(float))[0][back]
    f, v, own = quality_classifier.hashed(data, offsets, x)
    weights = quality_classifier.train(f, v.astype(np.float32), own, post)
    score = 1 / (1 + np.exp(-np.clip(np.bincount(own, v * weights[f], len(x)) + weights[-1], -30, 30)))
    found = {r["doc_id"]: r for r in quality_classifier.classify(documents).collect()}
    assert set(found) == set(ids)
    for i, d in enumerate(ids):
        r = found[d]
        assert (r["votes_junk"], r["votes_fine"]) == ((said[i] == 0).sum(), (said[i] == 2).sum())
        assert r["posterior"] == pytest.approx(post[i]) and r["score"] == pytest.approx(score[i], abs=1e-3) and r["kept"] == (r["score"] >= 0.5)


def test_trees_obey_their_constraints():
    rng = np.random.default_rng(4)
    x = rng.random((500, 3))
    y = (x[:, 0] + 0.3 * rng.random(500) < 0.6).astype(float)
    trees = quality_rules.grow(x, y, np.array([-1, 0, 1]), trees=20)
    grid = np.linspace(0, 1, 50)
    for row in x[:20]:
        for f, sign in ((0, -1), (2, 1)):
            moved = np.repeat(row[None], 50, 0)
            moved[:, f] = grid
            assert (sign * np.diff(trees.score(moved)) >= -1e-12).all()
    assert ((trees.score(x) > 0.5) == (y > 0)).mean() > 0.8


def operators(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    words, ranks, signs, pieces = (P.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"))
    return {
        "classifier": quality_classifier.classify, "packing": lambda d: packing.pack(d, words), "language": lambda d: language_id.identify(d, pieces), "rules": lambda d: quality_rules.judge(d, labels),
        "fingerprints": fingerprints.edited_likeness, "near": near_dedup.near_duplicates, "bpe": lambda d: bpe_codec.digests(d, ranks), "counts": lambda d: token_counts.count_tokens(d, signs),
        "pii": pii.digests, "secrets": secret_scan.digests, "mask": secret_scan.mask_secrets,
    }


NAMES = ["classifier", "packing", "language", "rules", "fingerprints", "near", "bpe", "counts", "pii", "secrets", "mask"]


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables_give_empty_results(name, spark, empty):
    assert operators(spark)[name](empty).count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_null_ids_repeated_rows_and_clashing_columns(name, spark, loose):
    rows = operators(spark)[name](loose).collect()
    assert len(rows) == 5
    assert sorted(str(r["doc_id"]) for r in rows) == ["7", "7", "8", "None", "None"]


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline")
def test_pipeline_stages_take_effect(spark, sf_dir, documents):
    import corpus_pipeline as C

    from test_contracts import components, secrets, stats

    assert [n for n, _ in C.STAGES] == ["quality_classifier", "quality_rules", "near_dedup", "secret_scan", "packing"]
    docs, seen = documents, {}
    for name, stage in C.STAGES[:-1]:
        before = docs
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), documents.schema)
        seen[name] = (before, docs)
        assert docs.columns == documents.columns
    text = lambda df: {r["doc_id"]: r["text"] or "" for r in df.collect()}
    before, after = map(text, seen["quality_rules"])
    assert set(after) <= set(before) and not any(s[0] < 20 or 100 * s[4] > 30 * s[0] for s in map(stats, after.values()))
    before, after = map(text, seen["near_dedup"])
    assert set(after) == {d for d, (_, top) in components(before).items() if d == top}
    before, after = map(text, seen["secret_scan"])
    assert set(before) == set(after) and not [s for t in after.values() for s in secrets(t) if s[0] != "assign"]
    assert C.run(spark, sf_dir).count() >= len(after)


def test_kept_word_scores_equal_direct_sums():
    path = P.path("piece_bpe_32k.model")
    p = np.random.default_rng(1).random((language_id.n_pieces(path) + 1, 3))
    scorer = language_id.Scorer(p / p.sum(0), path)
    for texts in (["", "Hello hello world's 12 x" + "ab" * 40, "123 !!"], ["hello again", "été"]):
        ((lo, hi, data, offsets),) = ragged.slices(pa.array(texts))
        words, word, owner = language_id.letter_words(data, offsets, None)
        logs = language_id.Lattice(words, path).words(scorer.p)
        for i in (i for i, w in enumerate(words) if len(w) > language_id.WORD_CHARS):
            logs[i] = language_id.long_word(words[i], scorer.p, path)
        total, seen = scorer(data, offsets)
        assert np.allclose(total, np.column_stack([np.bincount(owner, logs[word, k], hi - lo) for k in range(3)]))
        assert (seen == np.bincount(owner, minlength=hi - lo)).all()
    ((_, _, data, offsets),) = ragged.slices(pa.array(["", ""]))
    assert [len(x) for x in language_id.letter_words(data, offsets)] == [0, 0, 0]


def test_kept_rows_are_those_judged_kept(spark, sf_dir, documents):
    from sievemark.llm import quality_classifier, quality_rules

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    for kept, judged in ((quality_classifier.keep(documents), quality_classifier.classify(documents)), (quality_rules.keep(documents, labels), quality_rules.judge(documents, labels))):
        assert kept.schema == documents.schema
        assert ids(kept) == ids(judged.filter("kept")) != []
        assert sorted(map(repr, kept.collect())) == sorted(map(repr, documents.join(judged.filter("kept"), "doc_id", "left_semi").select(*documents.columns).collect()))


def test_flattened_trees_score_as_a_walk_through_them_does():
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(400, 4)), 1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    trees = quality_rules.grow(x, y, np.array([1, 0, 0, -1]), trees=12)
    inner = trees.feature.shape[1]
    asked = np.concatenate([x, rng.normal(scale=4, size=(100, 4)), trees.cut[:, :1].repeat(4, 1)[np.isfinite(trees.cut[:, 0])]])
    for row, score in zip(asked, trees.score(asked)):
        total = trees.base
        for feature, cut, value in zip(trees.feature, trees.cut, trees.value):
            node = 0
            while node < inner:
                node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
            total += value[node - inner]
        assert score == pytest.approx(1 / (1 + math.exp(-total)))


@pytest.mark.parametrize("size, block", [(33, 1 << 16), (100, 1 << 16), (100, 7), (1_500, 64)])
def test_long_words_are_scored_by_the_plain_forward_sum(size, block, monkeypatch):
    monkeypatch.setattr(language_id, "_BLOCK", block)
    path = P.path("piece_bpe_32k.model")
    names = language_id.pieces(path).names
    number = {n: i for i, n in enumerate(names)}
    rng = np.random.default_rng(size)
    p = np.vstack([rng.random((len(names), 2)) / 1_000, np.full((1, 2), language_id.UNKNOWN)])
    word = "".join(rng.choice(["the", "haus", "water", "q", "é", "語", "tion"], size))[:size]
    marked = chr(language_id.BEGIN) + word
    f = [0.0] + [-math.inf] * len(marked)
    for b in range(1, len(marked) + 1):
        terms = [f[a] + math.log(p[number.get(marked[a:b], -1), 1]) for a in range(max(0, b - language_id.PIECE_CHARS), b) if marked[a:b] in number or b == a + 1]
        top = max(terms)
        f[b] = top + math.log(sum(math.exp(t - top) for t in terms))
    assert language_id.long_word(word, p, path)[1] == pytest.approx(f[-1], rel=1e-9)
    data = word.encode()
    total, n = language_id.Scorer(p, path)(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert total[0, 1] == pytest.approx(f[-1], rel=1e-9) and n[0] == 1
