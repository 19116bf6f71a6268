"""Each operator's query result against a plain brute-force version."""

import hashlib
import re
import zlib
from collections import Counter

import public_tokenizers as P

from sievemark.llm import bpe_codec, fingerprints, near_dedup, packing, pii, quality_rules, secret_scan, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def by_id(df):
    found = {r["doc_id"]: r for r in df.collect()}
    return found


def test_packing_holds_every_id_once_with_little_padding(both, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {d: [*tok.encode(t, add_special_tokens=False).ids, 2] for d, t in texts.items()}
    rows = packing.pack(both, P.path("word_bpe_49k.json"), group_pieces=100).collect()
    per_doc, per_seq = {}, {}
    for r in rows:
        per_doc.setdefault(r["doc_id"], []).append(r)
        per_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(per_doc) == set(texts)
    for d, own in per_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids[d])
            part = ids[d][at : at + r["length"]]
            assert len(part) == r["length"] > 0
            assert zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids[d])
    for own in per_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    assert sum(r["length"] for r in rows) / (4096 * len(per_seq)) > 0.8


def test_first_fit_decreasing_is_the_plain_one():
    import numpy as np

    sizes = np.random.default_rng(1).integers(1, 101, 300)
    bins, offsets = packing.first_fit_decreasing(sizes, 100)
    room = []
    for i in np.argsort(-sizes, kind="stable"):
        b = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
        if b == len(room):
            room.append(100)
        assert (bins[i], offsets[i]) == (b, 100 - room[b])
        room[b] -= sizes[i]


def stats(text):
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    marked = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            marked |= set(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


def test_quality_rules_base(both, texts, spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = by_id(quality_rules.judge(both, labels))
    assert set(found) == set(texts)
    for d, t in texts.items():
        r, want = found[d], stats(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, t[:80]
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_fingerprints_and_edits(both, texts):
    found = by_id(fingerprints.edited_likeness(both))
    order = sorted(texts)
    assert set(found) == set(order)
    prints = {}
    for i, d in enumerate(order):
        text, after, r = texts[d], texts[order[(i + 1) % len(order)]], found[d]
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == sha(edited)
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
    long = [found[d] for d in order if len(set(texts[d].split())) > 200]
    assert long and sum(r["near_edited"] for r in long) > sum(r["near_next"] for r in long) + 0.3 * len(long)


def shingles(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < 5 else [tuple(words[i : i + 5]) for i in range(len(words) - 4)])


def components(texts):
    sets = {d: shingles(t) for d, t in texts.items()}
    top = {d: d for d in sets}

    def find(d):
        while top[d] != d:
            d = top[d]
        return d

    order = sorted(sets)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_near_duplicates(both, texts):
    found = by_id(near_dedup.near_duplicates(both))
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in found.items()} == components(texts)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found.values())


def test_near_duplicates_of_dense_groups(spark):
    """Chains of small edits and many copies: links within and between groups of one key."""
    import random

    rng = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    texts, n = {}, 0
    for _ in range(12):
        text = [rng.choice(words) for _ in range(rng.choice([6, 30, 80, 200]))]
        for _ in range(18):
            texts[n] = " ".join(text)
            n += 1
            text = list(text)
            for _ in range(rng.randrange(0, 1 + max(1, len(text) // 30))):
                text[rng.randrange(len(text))] = rng.choice(words)
    found = by_id(near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in found.items()} == components(texts)


def test_byte_bpe_round_trip(both, texts):
    import base64

    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = by_id(bpe_codec.digests(both, path))
    for d, t in texts.items():
        ids = enc.encode_ordinary(t)
        assert (found[d]["n_tokens"], found[d]["ids_sha256"], found[d]["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(t)), t[:80]


def test_token_counts(both, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    found = by_id(token_counts.count_tokens(both, P.path("byte_bpe_50k.json")))
    for d, t in texts.items():
        n = len(tok.encode(t, add_special_tokens=False).ids)
        assert (found[d]["n_bytes"], found[d]["n_tokens"], found[d]["over_limit"]) == (len(t.encode()), n, n > 1024), t[:80]


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def personal(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m[0])) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, ok in kinds for m in re.finditer(p, text) if ok(m)]


def secrets(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    kinds = [("assign", assign, lambda m: len(m[2]) >= 12), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16)]
    found = [(m.start(), i, k, m.end()) for i, (k, p, ok) in enumerate(kinds) for m in p.finditer(text) if ok(m)]
    return [(k, s, e) for s, _, k, e in sorted(found)]


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def test_personal_data_base(both, texts):
    found = by_id(pii.digests(both))
    for d, t in texts.items():
        want, r = personal(t), found[d]
        assert r["base_sha256"] == sha(joined(want)), (t[:80], want, r["spans"])
        assert all(r[f"n_{k}"] == sum(x[0] == k for x in want) for k in pii.BASE)
        spans = r["spans"].split(",") if r["spans"] else []
        assert spans[: len(want)] == [f"{k}:{s}:{e}" for k, s, e in want]
        keyed = [(pii.KINDS.index(k), int(s)) for k, s, _ in (x.split(":") for x in spans)]
        assert keyed == sorted(keyed)


def test_personal_data_is_added(odd):
    spans = " ".join(r["spans"] for r in pii.digests(odd).collect())
    assert "email_spelled" in spans or "national_id" in spans


def test_secrets_base(both, texts):
    found = by_id(secret_scan.digests(both))
    for d, t in texts.items():
        want, r = secrets(t), found[d]
        assert r["base_sha256"] == sha(joined(want)), (t[:80], want, r["spans"])
        assert all(r[f"n_{k}"] == sum(x[0] == k for x in want) for k in secret_scan.BASE)
        spans = r["spans"].split(",") if r["spans"] else []
        assert {f"{k}:{s}:{e}" for k, s, e in want} <= set(spans)
        keyed = [(int(s), secret_scan.KINDS.index(k)) for k, s, _ in (x.split(":") for x in spans)]
        assert keyed == sorted(keyed)


def test_widely_owned_values_are_examples(spark):
    value = "Zx9Qw2Er7Ty4Ui1Op5As8Df3"
    rows = [(i, f"key {value} here", f"s{i}") for i in range(6)] + [(9, "key Ab1Cd2Ef3Gh4Ij5Kl6Mn7Op8 here", "s0"), (10, "key Ab1Cd2Ef3Gh4Ij5Kl6Mn7Op8 here", "s0")]
    found = by_id(secret_scan.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    assert [len(found[i]["added"]) for i in range(6)] == [0] * 6 and found[0]["n_example"] == 1
    assert len(found[9]["added"]) == len(found[10]["added"]) == 1


def test_masking_leaves_no_base_secret_and_other_texts_alone(both, texts):
    for r in secret_scan.mask_secrets(both).collect():
        t = texts[r["doc_id"]]
        assert not [s for s in secrets(r["text"] or "") if s[0] != "assign"]
        if not secrets(t):
            assert "[SECRET]" in (r["text"] or "") or (r["text"] or "") == t


def test_near_duplicates_of_hot_keys(spark, monkeypatch):
    """Every shared key taken as a hot one: the same links."""
    import random

    monkeypatch.setattr(near_dedup, "HOT_PAIRS", 0)
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    texts = {}
    for _ in range(4):
        base = [rng.choice(words) for _ in range(rng.choice([8, 60, 150]))]
        for _ in range(30):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 12)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts[len(texts)] = " ".join(copy)
    found = by_id(near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in found.items()} == components(texts)


def test_a_passage_that_thousands_share_makes_no_pairs(spark):
    import random

    rng = random.Random(4)
    passage = " ".join(f"common{i}" for i in range(24))
    texts = {n: f"{passage} {' '.join(f'w{rng.randrange(10**9)}' for _ in range(26))}" for n in range(3_000)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert near_dedup.near_duplicates(docs).filter("kept").count() == 3_000
    nodes = docs.select("doc_id")
    common = near_dedup.shared_shingles(docs, nodes)
    assert common.count() == 20 * 3_000
    assert near_dedup.prefix_pairs(common, nodes.withColumn("component", nodes["doc_id"]), 0.75).count() == 0


def test_different_texts_of_one_id_are_one_document(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(3, a), (7, a), (7, b), (12, b), (20, c), (20, c)]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in found) == [(3, 3), (7, 3), (7, 3), (12, 3), (20, 20), (20, 20)]


def test_decoding_takes_ids_alone(spark):
    import pytest

    path = P.path("byte_bpe_50k.tiktoken")
    rows = [(1, [15496, 995]), (2, []), (3, None), (None, [220]), (1, [15496, 995])]
    found = bpe_codec.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), path).collect()
    assert sorted(bytes(r["decoded"]) for r in found) == [b"", b"", b" ", b"Hello world", b"Hello world"]
    texts = [(1, "Größe " + "q" * 500), (2, None)]
    encoded = bpe_codec.encode(spark.createDataFrame(texts, "doc_id long, text string"), path)
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in bpe_codec.decode(encoded, path).collect()} == {1: texts[0][1], 2: ""}
    with pytest.raises(Exception, match="an id that the vocabulary doesn't have"):
        bpe_codec.codec(path).decode(__import__("numpy").array([60_000]), [0, 1])


def test_limits_hold_at_any_number_of_rows():
    from sievemark.llm import language_id

    for rows in (10**3, 10**6, 10**10, 10**13):
        assert 0 < language_id.share_of(rows, 1_200) <= 1 and round(rows * language_id.share_of(rows, 1_200)) == min(rows, 1_200)
        assert rows / fingerprints.stretches(rows) <= fingerprints.MOST_ROWS


def test_stretches_share_the_rows(spark, monkeypatch):
    """Each stretch holds about as many rows as another, and the row after its last one."""
    monkeypatch.setattr(fingerprints, "STRETCH_ROWS", 100)
    rows = [(3 * i, f"t{i}") for i in range(2_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    bounds = fingerprints._bounds(docs.select("doc_id"))
    sizes = [r["count"] for r in docs.withColumn("s", fingerprints._place(bounds)).groupBy("s").count().collect()]
    assert len(bounds) == len(sizes) == 20 and max(sizes) < 3 * min(sizes)
    found = {r["doc_id"]: r["next"]["doc_id"] for r in fingerprints.beside_next(docs).collect()}
    assert found == {d: rows[(i + 1) % 2_000][0] for i, (d, _) in enumerate(rows)}
