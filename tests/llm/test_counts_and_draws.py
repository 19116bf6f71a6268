"""Exact duplicates, source divergence and importance resampling against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemark.llm import divergence, exact_dedup, queries, resampling

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text):
    return (text or "").translate(str.maketrans(UPPER, LOWER))


def records(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plain_duplicates(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[lowered(text)].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def test_exact_duplicates_are_those_of_whole_texts(both, loose, spark):
    for docs in (both, loose, both.withColumn("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 50))):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        assert records(exact_dedup.exact_duplicates(docs, digests=True)) == plain_duplicates(rows)


def test_full_content_is_hashed_for_surviving_groups_alone(spark):
    base = "x" * exact_dedup.PREFIX_CHARS
    rows = [(1, "only one of its length"), (2, base + "a"), (3, base + "b"), (4, "y" + base), (5, base.upper() + "A"), (6, "É" + base), (7, "é" + base)]
    found = {r["doc_id"]: r for r in exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d for d, r in found.items() if r["text_sha256"]} == {2, 3, 5}
    assert [found[d]["keep_id"] for d in range(1, 8)] == [1, 5, 3, 4, 5, 6, 7]


def test_groups_too_small_and_large_for_the_broadcast_are_joined_alike(spark):
    rows = [(i, "hot") for i in range(3_000)] + [(i, f"pair {i % 1_500}") for i in range(3_000, 6_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert records(exact_dedup.exact_duplicates(docs, digests=True)) == plain_duplicates(rows)


def plain_divergence(rows, min_docs, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        found = term.findall(lowered(text))
        counts[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    kept = {lang: [t for t, n in c.items() if n >= min_docs] for lang, c in docs.items()}

    def weights(count, terms):
        n = sum(count[t] for t in terms)
        return {t: 1 + 10**9 * (count[t] + 1) // (n + len(terms)) for t in terms}

    out = []
    p = {g: weights(c, kept[g[0]]) for g, c in counts.items()}
    for (lang, source), mine in p.items():
        q = weights(sum((c for (x, _), c in counts.items() if x == lang), Counter()), kept[lang])
        pairs = [(s, sum((mine[t] - o[t]) ** 2 // o[t] for t in mine)) for (x, s), o in p.items() if x == lang and s != source]
        terms = [(t, (mine[t] - q[t]) ** 2 // q[t]) for t in mine if counts[lang, source][t] and mine[t] > q[t]]
        for part, items, most in (("pair", pairs, None), ("term", terms, top)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(items[:most])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_docs, top", [(3, 200), (1, 5), (2, 10_000)])
def test_divergence_is_the_plain_one(min_docs, top, odd, loose, documents):
    for docs in (odd, loose, documents):
        rows = [(r["lang"], r["source"], r["text"]) for r in docs.collect()]
        assert records(divergence.divergence(docs, min_docs, top)) == plain_divergence(rows, min_docs, top)


def test_divergence_with_many_groups_and_large_counts(spark, documents, monkeypatch):
    expected = records(divergence.divergence(documents))
    monkeypatch.setattr(divergence, "BROADCAST_ROWS", 0)  # the shuffled, salted joins
    monkeypatch.setattr(divergence, "PART_SOURCES", 3)
    assert records(divergence.divergence(documents)) == expected
    big = spark.range(1).select(divergence._weight(F.lit(9 * 10**18), F.lit(9 * 10**18), F.lit(7)).alias("p")).first()[0]
    assert big == 1 + 10**9 * (9 * 10**18 + 1) // (9 * 10**18 + 7)


def test_the_sketch_never_underestimates_and_merges_to_the_whole(spark, documents):
    docs = divergence._columns(documents)
    seen = Counter()
    for r in docs.collect():
        seen.update((r["lang"], t) for t in set(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(r["text"]))))
    import pyarrow as pa

    hashes = divergence._hashes(pa.array([x for x, _ in seen]), pa.array([t for _, t in seen]))
    true = np.minimum(np.array(list(seen.values())), 3)
    for parts in (1, 7):
        sketch = divergence.frequency_sketch(docs.repartition(parts))
        found = divergence.estimates(sketch, hashes)
        assert (found >= true).all() and (found == true).mean() > 0.9


def plain_runs(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    return len(words), [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain_draw(rows, target, percent=5, min_words=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    runs = [(d, *plain_runs(t)) for d, t in rows]
    s, t = Counter(bucket(f) for _, _, fs in runs for f in fs), Counter(bucket(f) for x in target for f in plain_runs(x)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + 10_000) / ((s[b] + 1) * (n_t + 10_000)))) for b in range(10_000)]
    out = []
    for d, n_words, fs in runs:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in fs)
        out.append([d, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n_words >= min_words])
    eligible = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(eligible[: percent * len(eligible) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize("percent", [0, 5, 60, 100])
def test_the_draw_is_the_plain_one(percent, both, loose, spark, sf_dir, monkeypatch):
    monkeypatch.setattr(resampling, "RANGE_ROWS", 9)
    monkeypatch.setattr(resampling, "CHUNK_ROWS", 4)
    monkeypatch.setattr(resampling, "RUN_ROWS", 50)
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    wanted = [r["text"] for r in target.collect()]
    for docs in (both, loose.unionByName(loose)):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        assert records(resampling.resample(docs.repartition(6), target, percent)) == plain_draw(rows, wanted, percent)


def test_equal_scores_are_dealt_to_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(resampling, "RANGE_ROWS", 20)
    monkeypatch.setattr(resampling, "noise", lambda doc_id: 0)
    docs = spark.range(1_000).select(F.col("id").alias("doc_id"), F.lit("same words " * 15).alias("text"))
    found = {r["doc_id"]: r["rank"] for r in resampling.resample(docs, docs.limit(0), 30).collect()}
    assert [found[i] for i in range(1_000)] == [*range(1, 301), *[None] * 700]


def test_checksums_of_runs_are_those_of_the_bytes():
    rng = random.Random(3)
    words = ["".join(rng.choice("abc9é語") for _ in range(n)) for n in [*range(1, 140), 1, 5_000, 70_000]]
    rng.shuffle(words)
    text = "  ".join(words).encode()
    first, runs = resampling.run_buckets(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    for n, (at, buckets) in enumerate(runs, 1):
        assert list(buckets) == [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for i in at] and len(at) == len(words) - n + 1


def test_the_tournament_merges_runs_in_chunks():
    rng = random.Random(8)
    runs = [sorted((rng.randrange(50),) for _ in range(rng.randrange(40))) for _ in range(13)]
    chunks = sorted((run[i], run[i : i + 3]) for run in runs for i in range(0, len(run), 3))
    every = sorted(x for run in runs for x in run)
    for most in (0, 1, 17, len(every), len(every) + 5):
        found = list(resampling.merged(((lead, iter(rows)) for lead, rows in chunks), most))
        assert found[:most] == every[:most] and sorted(found) == every


def test_no_rows_in_no_rows_out(empty, spark):
    target = spark.createDataFrame([("some words",)], "text string")
    for found in (exact_dedup.exact_duplicates(empty), divergence.divergence(empty), resampling.resample(empty, target)):
        assert found.columns and found.count() == 0


@pytest.mark.parametrize("name", ["op11_exact_dedup", "op12_source_divergence"])
def test_queries_give_the_rows_of_their_sql(name, spark, sf_dir, duck):
    asked = duck.execute(queries.oracle_sql()[name])
    order = [c[0] for c in asked.description]
    assert records(queries.queries()[name](spark, sf_dir).select(*order)) == sorted(asked.fetchall(), key=repr)
