"""Added spans, fingerprints and language models against plain Python."""

import math
import re
import struct
import zlib
from collections import Counter

import pytest
import regex
import xxhash

import public_tokenizers as P
from sievemark.llm import fingerprints, language_id, pii, secret_scan
from test_contracts import by_id, personal, secrets


def wider(patterns, text, base, touches):
    found = [(k, m.start(), m.end(), m[0]) for k, p in patterns.items() for m in re.finditer(p, text, re.A)]
    return [s for s in found if not any(touches(s, b) for b in base)]


def over(s, b):
    return b[1] < s[2] and s[1] < b[2]


def test_added_secrets_follow_the_owners(both, texts):
    owner = {r["doc_id"]: r["source"] or "" for r in both.collect()}
    kinds = lambda s: s[0] != "mixed" or all(re.search(c, s[3]) for c in ("[0-9]", "[a-z]", "[A-Z]"))
    touch = lambda s, b: over(s, b) and (s[0] != "private_key" or b[1] <= s[1] and s[2] <= b[2])
    value = lambda t, k, a, b: re.sub(r"(?i)^(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?", "", t[a:b]) if k == "assign" else t[a:b]
    held, cands = {}, {}
    for d, t in texts.items():
        base = secrets(t)
        cands[d] = [s for s in wider(secret_scan.WIDER, t, [(k, a, b) for k, a, b in base], touch) if kinds(s)]
        for v in [value(t, k, a, b) for k, a, b in base] + [s[3] for s in cands[d]]:
            held.setdefault(v, set()).add((owner[d], d))
    example = {v for v, who in held.items() if len({o for o, _ in who}) >= 5 or len({o for o, _ in who}) >= 2 and len(who) >= 20}
    found = by_id(secret_scan.find_secrets(both))
    for d, t in texts.items():
        assert sorted((s["kind"], s["start"], s["end"]) for s in found[d]["added"]) == sorted(s[:3] for s in cands[d] if s[3] not in example), t[:80]
        assert found[d]["n_example"] == sum(value(t, k, a, b) in example for k, a, b in secrets(t)) + sum(s[3] in example for s in cands[d])


def vote(yes, no):
    return 2 if yes else 0 if no else 1


def votes(text, kind, start, end):
    """A candidate's eight votes by hand, for kinds of the wider patterns and emails, addresses, cards and phones."""
    s, has = text[start:end], lambda p, x: re.search(p, x, re.A) is not None
    digits = re.sub("[^0-9]", "", s)
    before, after = text[max(0, start - pii.WIDE) : start], text[end : end + pii.WIDE]
    ahead, around = before[-pii.CONTEXT :], before + " " + after
    listed = lambda words: has(r"(?i)\b(?:" + "|".join(words) + r")\b", around)
    form = {
        "email": (has(r"(?i)[a-z].*(?:@|at[)\]])", s), has(r"(?i)^[^a-z]*(?:@|[\[(]at)", s)), "ip": (has("^[1-9][0-9]*[.].*[.](?:0|[1-9][0-9]*)$", s), has(r"(?:^|\.)0[0-9]", s)),
        "card": (has(r"^[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}$|^[0-9]{4}([\x20-]?)[0-9]{6}\2[0-9]{5}$", s), has(r"(?:^|[\x20-])[0-9]{1,2}[\x20-]", s)),
        "phone": (has(r"^\+[0-9]{1,3}[\x20.-]?(?:\([0-9]+\)|[0-9]{2,})", s), has(r"[\x20().-]{3}", s)), "bank_account": (len(digits) >= 12, len(digits) < 8),
    }
    form["email_spelled"] = form["email"]
    issuer = {
        "email": (has(r"(?i)(?:[.]|dot[)\]])\x20?(?:" + "|".join(pii.ENDINGS) + ")$", s), has("[0-9]$", s)),
        "ip": (has("^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])[.]", s), has("^0|^127[.]|^255[.]|^22[4-9]|^2[34]", s)), "card": (has(f"^(?:{pii.ISSUERS})", digits), has("^[0179]", digits)),
        "phone": (has(f"^(?:{pii.CALLING_CODES})", digits), has("^0", digits)), "phone_local": (has("^[2-9][0-9]{2}[2-9]", digits), has("^[01]|^...[01]", digits)),
        "national_id": (not has("^000|^666|^9|^...00|0000$", digits), True), "bank_account": (s[:2] in pii.BANK_COUNTRIES, True),
    }
    issuer["email_spelled"] = issuer["email"]
    return [
        vote(*form.get(kind, (True, False))), vote(len(set(digits)) >= 4, has(r"^([0-9])\1{5,}$|^0123456|^1234567", digits)), vote(*issuer[kind]), vote(listed(pii.NAMES), False), vote(listed(pii.PLACES), False),
        vote(has("(?i)" + pii.CUES[pii.CUE_OF[kind]], ahead), has("(?i)version|section|page|figure|isbn|total|sum", ahead)), vote(has(r"[A-Za-z]\x20?[:=#]\x20?[\"']?\Z", ahead), has(r"[$%/]\x20?\Z", ahead)),
        vote(not has(r"[A-Za-z0-9_]\Z", ahead) and not has("^[A-Za-z0-9_]", after), has(r"[A-Za-z0-9_]\Z", ahead) and has("^[A-Za-z0-9_]", after)),
    ]


def test_added_personal_data_follows_the_votes(both, texts):
    counts, cands = Counter(), {}
    for d, t in texts.items():
        base = personal(t)
        cands[d] = [(k, a, b) for k, a, b, _ in wider(pii.WIDER, t, base, over)]
        for k, a, b in base + cands[d]:
            code = 0
            for v in votes(t, k, a, b):
                code = code * 3 + v
            counts[k, code] += 1
            if k in pii.WIDER:
                cands[d][cands[d].index((k, a, b))] = (k, a, b, code)
    by_votes = Counter()
    for (_, c), n in counts.items():
        by_votes[c] += n
    value = pii.span_classifier(dict(counts), pii.reliabilities(dict(by_votes))[2])
    found = by_id(pii.find_personal_data(both))
    for d, t in texts.items():
        assert [(s["kind"], s["start"], s["end"]) for s in found[d]["added"]] == [c[:3] for c in cands[d] if value[c[0], c[3]] >= 0.5], t[:80]


def test_reliabilities_of_known_labellers_are_recovered():
    import random

    rng, n = random.Random(5), len(pii.LABELLERS)
    accuracy, counts = [0.7 + 0.25 * j / (n - 1) for j in range(n)], Counter()
    for _ in range(30_000):
        good = rng.random() < 0.7
        code = 0
        for a in accuracy:
            code = code * 3 + (1 if rng.random() < 0.3 else 2 if (rng.random() < a) == good else 0)
        counts[code] += 1
    tables, prior, post = pii.reliabilities(dict(counts))
    assert prior == pytest.approx(0.7, abs=0.02)
    for t, a in zip(tables, accuracy):
        assert t[2][0] / (t[2][0] + t[0][0]) == pytest.approx(a, abs=0.02) and t[0][1] / (t[2][1] + t[0][1]) == pytest.approx(a, abs=0.03)


def xx(*values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v if isinstance(v, bytes) else struct.pack("<q", v), seed % 2**64)
        seed -= (seed >> 63) << 64
    return seed


def anchors(text):
    signs = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
    run = rf"[^\x20\x09-\x0D{signs}]"
    hashes = [xx(t) for t in regex.findall(rf"{run}{{1,24}}+(?!{run})|[^\x20\x09-\x0D]", text)]
    if len(hashes) < 4:
        return [(i, xx(h, struct.pack("<i", 4))) for i, h in enumerate(hashes)]
    inner = [xx(hashes[i], hashes[i + 1]) for i in range(len(hashes) - 1)]
    return [(i, xx(*hashes[i : i + 4])) for i in range(len(hashes) - 3) if min(inner[i], inner[i + 2]) <= inner[i + 1]]


def sketch(text):
    first = {}
    for pos, h in anchors(text):
        first.setdefault(h, pos)
    return {h: first[h] for h in sorted(first)[: max(64, len(first) // 16)]}


def likeness(a, b):
    union = sorted({*a, *b})[: min([len(x) for x in (a, b) if len(x) >= 64], default=None)]
    if not union:
        return 1.0
    moved = Counter(b[h] - a[h] for h in union if h in a and h in b)
    return sum(n for d, n in moved.items() if d == 0 or n > 1) / len(union)


def test_fingerprints_are_positional_syncmers(both, texts):
    found, order = by_id(fingerprints.edited_likeness(both)), sorted(texts)
    own = {d: sketch(texts[d]) for d in order}
    told = lambda s: " ".join(f"{h & (2**64 - 1):x}.{p}" for h, p in s.items())
    for i, d in enumerate(order):
        nxt, q = order[(i + 1) % len(order)], len(texts[d]) // 4
        edited = sketch(texts[d][: len(texts[d]) - q] + texts[nxt][:q])
        r = found[d]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (told(own[d]), told(edited)), texts[d][:60]
        assert (r["near_edited"], r["near_next"]) == (pytest.approx(likeness(own[d], edited)), pytest.approx(likeness(own[d], own[nxt])))


def test_moved_passages_match_and_scattered_ones_do_not(spark):
    words = [f"w{i}" for i in range(900)]
    rows = [(1, " ".join(words)), (2, " ".join(f"v{i}" for i in range(100)) + " " + " ".join(words)), (3, " ".join(w for i in range(0, 900, 6) for w in [*words[i : i + 6], f"u{i}"])[::1]), (4, "別の文 " + "東京都は日本の首都であり世界最大級の都市です" * 3), (5, "東京都は日本の首都であり世界最大級の都市です" * 3)]
    s = {r["doc_id"]: r for r in spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", fingerprints.sketch(fingerprints.F.col("text")).alias("s")).collect()}
    d = spark.createDataFrame([(s[a]["s"], s[b]["s"]) for a, b in ((1, 2), (1, 3), (4, 5))], "a array<struct<hash: long, pos: int>>, b array<struct<hash: long, pos: int>>")
    moved, scattered, unspaced = (r[0] for r in d.select(fingerprints.likeness(fingerprints.F.col("a"), fingerprints.F.col("b"))).collect())
    assert moved > 0.75 and scattered < 0.3 and unspaced > 0.5


def test_language_model_is_learnt_and_scored_as_by_hand(spark):
    path = P.path("piece_bpe_32k.model")
    names = language_id.pieces(path).names
    number, longest = {n: i for i, n in enumerate(names)}, max(map(len, names))
    lines = {"en": "the house is near the water and they walk home", "de": "das haus steht nahe am wasser und sie gehen heim", "fr": "la maison est au bord de leau et ils rentrent"}
    rows = [(i, lines[lang] + " " + lines[lang].split()[i % 8], lang) for i, lang in enumerate(lang for _ in range(8) for lang in lines)]
    rows += [(900, None, "en"), (901, "12 !!", "en"), (902, "zzz das wasser", None), (None, "haus", "de")]
    learnt = [(t, lang) for d, t, lang in rows if d is not None and t and lang and zlib.crc32(str(d).encode()) % 3 != 1]
    langs = sorted({x for _, x in learnt})
    p = {x: {**{i: 1 / len(names) for i in range(len(names))}, -1: language_id.UNKNOWN} for x in langs}

    def cuts(word):
        return [(a, b, number.get(word[a:b], -1)) for a in range(len(word)) for b in range(a + 1, min(len(word), a + longest) + 1) if word[a:b] in number or b == a + 1]

    def forward(word, q):
        f = [1.0] + [0.0] * len(word)
        for a, b, i in sorted(cuts(word), key=lambda c: c[1]):
            f[b] += f[a] * q[i]
        return f

    words = lambda t: ["▁" + w for w in t.split() if w.isalpha()]
    for _ in range(language_id.ROUNDS):
        fresh = {}
        for x in langs:
            n = dict.fromkeys(range(len(names)), 0.02)
            for w in (w for t, lang in learnt if lang == x for w in words(t)):
                f, g = forward(w, p[x]), [0.0] * len(w) + [1.0]
                for a, b, i in sorted(cuts(w), key=lambda c: -c[0]):
                    g[a] += g[b] * p[x][i]
                for a, b, i in cuts(w):
                    if i >= 0:
                        n[i] += f[a] * p[x][i] * g[b] / f[-1]
            total = sum(n.values())
            fresh[x] = {**{i: v / total for i, v in n.items()}, -1: language_id.UNKNOWN}
        p = fresh
    found = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), path).collect()}
    assert set(found) == {d for d, _, _ in rows}
    for d, t, _ in rows:
        r = found[d]
        if not any(c.isalpha() for c in t or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        logs = {x: sum(math.log(forward(w, p[x])[-1]) for w in words(t)) for x in langs}
        best, share = max(logs.values()), min(1, language_id.SCORE_WORDS / len(words(t)))
        assert r["lang_pred"] == max(langs, key=lambda x: logs[x]) and r["held_out"] == (d is not None and zlib.crc32(str(d).encode()) % 3 == 1)
        assert r["score"] == pytest.approx(1 / sum(math.exp((v - best) * share) for v in logs.values()), abs=1e-4)


def test_ties_go_to_the_first_language(spark):
    free = [d for d in range(40) if zlib.crc32(str(d).encode()) % 3 != 1]
    rows = [(free[0], "same words here", "xx"), (free[1], "same words here", "aa"), (free[2], "words", None), (free[3], "a1 b2", None)]
    found = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), P.path("piece_bpe_32k.model")).collect()}
    assert {r["lang_pred"] for r in found.values()} == {"aa"} and found[free[2]]["score"] == pytest.approx(0.5)
