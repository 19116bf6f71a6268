"""Personal data by weak supervision, in DataFrame expressions.

Base patterns give spans that always stay. Wider patterns give further candidates. Labellers of three sorts vote on
every candidate, base or not: patterns (form, variety), gazetteers (issuers, names, places) and context (cue words,
labels, edges). Expectation-maximisation over the counts of vote patterns, of which there are few whatever the input,
estimates their reliabilities; the posteriors train a logistic span classifier on votes and kind, which decides on
the further candidates.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import native
from .common import materialize

#: The base patterns. Possessive repeats where nothing that follows could use what they give back; a match
#: can only begin where a run of its signs does (or where the match before it ended), which keeps long runs linear.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Further candidates, by kinds of their own.
WIDER = {
    "email_spelled": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|\[dot\]|\(dot\))\x20?[A-Za-z0-9-]{1,63}+){1,8}+",
    "phone_local": r"(?<![0-9+(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "bank_account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
KINDS = [*BASE, *WIDER]
CUES = {"email": "mail|contact|write|reach", "ip": r"ip\b|host|server|address|login", "card": "card|visa|credit|pay|iban|account|bank", "phone": "phone|call|tel|mobile|fax|contact", "id": "ssn|social|birth|national|passport"}
CUE_OF = {"email": "email", "ip": "ip", "card": "card", "phone": "phone", "email_spelled": "email", "phone_local": "phone", "national_id": "id", "bank_account": "card"}
LABELLERS = ["form", "variety", "issuer", "names", "places", "cue", "label", "edges"]
#: Code points of a candidate's context: near ones before it for cues and labels, and wide ones on both sides for gazetteers.
CONTEXT, WIDE = 32, 80

#: Gazetteers. Endings of mail domains (two letters are a country's), the country codes of phone numbers,
#: the first digits of card issuers, and the countries of bank account numbers.
ENDINGS = "com org net edu gov mil int info biz name pro example test [a-z]{2}".split()
CALLING_CODES = r"1|7|2(?:0|7|[1-689][0-9])|3(?:[0-469]|[578][0-9])|4(?:[013-9]|2[0-9])|5(?:[1-8]|[09][0-9])|6(?:[0-6]|[789][0-9])|8(?:[1246]|[05789][0-9])|9(?:[0-58]|[679][0-9])"
ISSUERS = r"4|5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3(?:[47]|0[0-5]|[68]|5(?:2[89]|[3-8]))|6(?:011|4[4-9]|5|2)"
BANK_COUNTRIES = "AD AE AL AT AZ BA BE BG BH BR BY CH CR CY CZ DE DK DO EE EG ES FI FO FR GB GE GI GL GR GT HR HU IE IL IQ IS IT JO KW KZ LB LC LI LT LU LV LY MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SC SE SI SK SM ST SV TL TN TR UA VA VG XK".split()
#: Common names and titles, and large places.
NAMES = """mr mrs ms dr prof herr frau monsieur madame don dona
james john robert michael william david richard joseph thomas charles mary patricia jennifer linda elizabeth barbara susan jessica sarah karen
anna maria peter hans klaus juergen sabine ursula andreas stefan jean pierre michel marie nathalie isabelle philippe jose juan carlos luis carmen
ana pedro miguel lucia sofia wei ming li yuki hiroshi ahmed mohammed fatima ivan olga
smith johnson williams brown jones garcia miller davis rodriguez martinez mueller schmidt schneider fischer weber meyer wagner becker dupont durand
martin bernard dubois lopez gonzalez perez sanchez kim nguyen""".split()
PLACES = """london paris berlin madrid rome vienna zurich geneva munich hamburg cologne frankfurt lyon marseille toulouse barcelona valencia seville lisbon
dublin brussels amsterdam copenhagen oslo stockholm helsinki warsaw prague budapest athens istanbul moscow kyiv york boston chicago houston dallas
seattle denver miami atlanta toronto montreal sydney melbourne tokyo osaka seoul beijing shanghai delhi mumbai cairo lagos nairobi
street road avenue strasse rue calle platz city""".split()


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _passes(kind: str, s: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"))
    if kind == "card":
        return native.let(_digits(s), lambda d: F.length(d).between(13, 19) & native.luhn(d))
    if kind == "phone":
        return F.length(_digits(s)).between(9, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 2).when(no, 0).otherwise(1)


def _listed(text: Column, words: list[str]) -> Column:
    return text.rlike(r"(?i)\b(?:" + "|".join(words) + r")\b")


def _form(kind: str, body: Column, digits: Column) -> Column:
    """Whether the text itself is built like its kind (a base span's checks have passed; more is asked here)."""
    if kind in ("email", "email_spelled"):
        return _vote(body.rlike(r"(?i)[a-z].*(?:@|at[)\]])"), body.rlike(r"(?i)^[^a-z]*(?:@|[\[(]at)"))
    if kind == "ip":
        return _vote(body.rlike("^[1-9][0-9]*[.].*[.](?:0|[1-9][0-9]*)$"), body.rlike(r"(?:^|\.)0[0-9]"))
    if kind == "card":
        return _vote(body.rlike(r"^[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}$|^[0-9]{4}([\x20-]?)[0-9]{6}\2[0-9]{5}$"), body.rlike(r"(?:^|[\x20-])[0-9]{1,2}[\x20-]"))
    if kind == "phone":
        return _vote(body.rlike(r"^\+[0-9]{1,3}[\x20.-]?(?:\([0-9]+\)|[0-9]{2,})"), body.rlike("[\\x20().-]{3}"))
    if kind == "bank_account":
        return _vote(F.length(digits) >= 12, F.length(digits) < 8)
    return F.lit(2)


def _issuer(kind: str, body: Column, digits: Column) -> Column:
    """Whether who gave the number or name is listed."""
    if kind in ("email", "email_spelled"):
        return _vote(body.rlike(r"(?i)(?:[.]|dot[)\]])\x20?(?:" + "|".join(ENDINGS) + ")$"), body.rlike("[0-9]$"))
    if kind == "ip":
        return _vote(body.rlike("^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])[.]"), body.rlike("^0|^127[.]|^255[.]|^22[4-9]|^2[34]"))
    if kind == "card":
        return _vote(digits.rlike(f"^(?:{ISSUERS})"), digits.rlike("^[0179]"))
    if kind == "phone":
        return _vote(digits.rlike(f"^(?:{CALLING_CODES})"), digits.rlike("^0"))
    if kind == "phone_local":
        return _vote(digits.rlike("^[2-9][0-9]{2}[2-9]"), digits.rlike("^[01]|^...[01]"))
    if kind == "national_id":
        return _vote(~digits.rlike("^000|^666|^9|^...00|0000$"), digits.rlike("^000|^666|^9|^...00|0000$"))
    return _vote(body.rlike("^(?:" + "|".join(BANK_COUNTRIES) + ")"), ~body.rlike("^(?:" + "|".join(BANK_COUNTRIES) + ")"))


def _votes(parts: Column, length: Column, kind: str) -> Callable[[Column], Column]:
    """A candidate's vote pattern: one ternary digit for each labeller (2 personal, 1 no vote, 0 not). parts: the text's blocks."""

    def of(s: Column) -> Column:
        body = s["text"]
        digits = _digits(body)
        begin, end = F.greatest(s["start"] - WIDE, F.lit(0)), F.least(s["end"] + WIDE, length)
        before, after = native.piece(parts, begin, s["start"] - begin), native.piece(parts, s["end"], end - s["end"])
        return native.let(F.struct(before.alias("before"), after.alias("after")), lambda c: coded(s, body, digits, c["before"], c["after"]))

    def coded(s: Column, body: Column, digits: Column, before: Column, after: Column) -> Column:
        ahead = F.substring(before, F.greatest(F.length(before) - CONTEXT, F.lit(0)) + 1, F.lit(CONTEXT))
        around = F.concat(before, F.lit(" "), after)
        votes = {
            "form": _form(kind, body, digits),
            "variety": _vote(F.size(F.array_distinct(F.split(digits, ""))) >= 4, digits.rlike(r"^([0-9])\1{5,}$|^0123456|^1234567")),
            "issuer": _issuer(kind, body, digits),
            "names": _vote(_listed(around, NAMES), F.lit(False)),
            "places": _vote(_listed(around, PLACES), F.lit(False)),
            "cue": _vote(ahead.rlike("(?i)" + CUES[CUE_OF[kind]]), ahead.rlike("(?i)version|section|page|figure|isbn|total|sum")),
            "label": _vote(ahead.rlike(r"[A-Za-z]\x20?[:=#]\x20?[\"']?$"), ahead.rlike(r"[$%/]\x20?$")),
            "edges": _vote(~ahead.rlike("[A-Za-z0-9_]$") & ~after.rlike("^[A-Za-z0-9_]"), ahead.rlike("[A-Za-z0-9_]$") & after.rlike("^[A-Za-z0-9_]")),
        }
        code = F.lit(0)
        for name in LABELLERS:
            code = code * 3 + votes[name]
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), code.alias("votes"))

    return of


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id (the id column), base and wider: arrays of struct(kind, start, end, votes); wider spans that touch a base span are left out."""
    text = F.col("clean")
    plain = docs.select(F.col(id_col).alias("id"), native.clean(F.col(text_col).cast("string")).alias("clean"))
    needs = {"email": text.contains("@"), "phone": text.contains("+"), "email_spelled": F.lower(text).rlike(r"[\[(]at[)\]]"), "bank_account": text.rlike("[A-Z]{2}[0-9]{2}")}
    found = plain.select("*", *(native.find(text, k, p, needs.get(k)).alias(f"found_{k}") for k, p in (BASE | WIDER).items()))
    passing = lambda k: F.filter(f"found_{k}", lambda s: _passes(k, s["text"])).alias(f"found_{k}")
    passed = found.select("id", "clean", *map(passing, KINDS))
    none = F.array().cast("array<struct<kind: string, start: int, end: int, votes: int>>")

    def voted(kinds: dict) -> Column:
        some = reduce(lambda a, b: a | b, (F.size(f"found_{k}") > 0 for k in kinds))
        all_of = lambda parts: F.concat(*(F.transform(f"found_{k}", _votes(parts, F.length(text), k)) for k in kinds))
        return F.when(some, native.let(native.blocks(text), all_of)).otherwise(none)

    apart = native.apart(F.col("wider"), F.col("base"), lambda s, b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return passed.select("id", voted(BASE).alias("base"), voted(WIDER).alias("wider")).withColumn("wider", apart)


def reliabilities(counts: dict[int, int], rounds: int = 30) -> tuple[list[dict[int, tuple[float, float]]], float, dict[int, float]]:
    """EM over vote patterns: for each labeller P(vote | personal), P(vote | not), the prior, and each pattern's posterior.

    It begins with the majority of the votes; a labeller that abstains says nothing about a candidate. Each count has half
    a candidate of either class added to it.
    """
    patterns = sorted(counts)
    votes = {c: _unpack(c) for c in patterns}
    post = {c: min(0.95, max(0.05, 0.5 + 0.15 * sum(v - 1 for v in votes[c]))) for c in patterns}
    tables, prior = [], 0.5
    for _ in range(rounds):
        good = sum(counts[c] * post[c] for c in patterns) + 1.0
        bad = sum(counts[c] * (1 - post[c]) for c in patterns) + 1.0
        prior = good / (good + bad)
        tables = []
        for j in range(len(LABELLERS)):
            weight = {v: [0.5, 0.5] for v in range(3)}
            for c in patterns:
                weight[votes[c][j]][0] += counts[c] * post[c]
                weight[votes[c][j]][1] += counts[c] * (1 - post[c])
            sums = [sum(w[i] for w in weight.values()) for i in (0, 1)]
            tables.append({v: (w[0] / sums[0], w[1] / sums[1]) for v, w in weight.items()})
        for c in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(tables[j][v][0] / tables[j][v][1]) for j, v in enumerate(votes[c]) if v != 1)
            post[c] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return tables, prior, post


def _unpack(code: int) -> list[int]:
    return [code // 3 ** (len(LABELLERS) - 1 - j) % 3 for j in range(len(LABELLERS))]


def span_classifier(counts: dict[tuple[str, int], int], posterior: dict[int, float], steps: int = 200) -> dict[tuple[str, int], float]:
    """Logistic regression on votes and kind, trained on posteriors weighted by counts; its value for each pattern seen."""
    total = sum(counts.values()) or 1
    kinds = sorted({k for k, _ in counts})
    rows = [((k, c), [1.0, *(v - 1.0 for v in _unpack(c)), *(float(k == x) for x in kinds)], n / total, posterior[c]) for (k, c), n in sorted(counts.items())]
    weights = [0.0] * (1 + len(LABELLERS) + len(kinds))
    value = lambda x: 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(weights, x))))))
    for _ in range(steps):
        slope = [0.001 * w for w in weights]
        for _, x, n, y in rows:
            miss = n * (value(x) - y)
            slope = [s + miss * a for s, a in zip(slope, x)]
        weights = [w - 1.0 * s for w, s in zip(weights, slope)]
    return {key: value(x) for key, x, _, _ in rows}


def find_personal_data(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id_col, base and added (arrays of struct(kind, start, end)), added by the span classifier.

    Places are code points, ends exclusive. Null or empty texts have no spans. Null ids, repeated rows, ties and
    other columns are allowed: one row out for each row; an empty table gives an empty result. Whole texts are read.
    """
    found = materialize(candidates(docs, id_col, text_col))
    voted = found.select(F.explode(F.concat("base", "wider")).alias("s")).groupBy("s.kind", "s.votes").count().collect()  # at most kinds x 3^labellers rows
    counts = {(r["kind"], r["votes"]): r["count"] for r in voted}
    by_votes: dict[int, int] = {}
    for (_, c), n in counts.items():
        by_votes[c] = by_votes.get(c, 0) + n
    _, _, posterior = reliabilities(by_votes)
    value = span_classifier(counts, posterior)
    chosen = [f"{k}:{c}" for (k, c), p in sorted(value.items()) if k in WIDER and p >= threshold]
    taken = lambda s: F.concat_ws(":", s["kind"], s["votes"].cast("string")).isin(chosen) if chosen else F.lit(False)
    bare = lambda spans: F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select(F.col("id").alias(id_col), bare(F.col("base")).alias("base"), bare(F.filter("wider", taken)).alias("added"))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """find_personal_data() as counts of base spans by kind, base_sha256 and spans (kind:start:end by kind, then start)."""
    found = find_personal_data(docs, id_col=id_col, text_col=text_col)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(id_col, *map(count, BASE), F.sha2(native.written(F.col("base")), 256).alias("base_sha256"), native.written(F.concat("base", "added")).alias("spans"))
