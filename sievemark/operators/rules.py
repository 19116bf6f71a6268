"""Ordered rule tables over texts: one scan finds every pattern, the first rule by its place decides."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rules that one scan may hold.
MOST_RULES = 5_000

#: What a text's role lets its status, relation and relevance be, where no pattern says otherwise.
STATUS = {"BACKGROUND": "DESCRIPTIVE", "DEFINE": "DESCRIPTIVE", "RESULT": "DESCRIPTIVE", "EXAMPLE": "DESCRIPTIVE", "NEXT_STEP": "ACTIVE", "METHOD": "ACTIVE", "LIMITATION": "LIMITED", "CLAIM": "ACTIVE"}
RELATION = {"BACKGROUND": "sets_context", "DEFINE": "defines", "METHOD": "recommends", "RESULT": "reports_usefulness", "LIMITATION": "warns_about", "NEXT_STEP": "proposes_next_test", "EXAMPLE": "gives_example", "CLAIM": "asserts"}
RELATION_WORDS = {"METHOD": (("map", "maps_to"), ("require", "requires"), ("obligation", "requires")), "RESULT": (("retrieval", "supports_retrieval"),)}


@dataclass(frozen=True)
class Rule:
    """Texts that start with a pattern as it is written, or contain it in any case, have the role, unless an earlier rule decides."""

    kind: str  # starts or contains
    pattern: str
    role: str


def _quoted(pattern: str) -> str:
    return re.sub(r"([^A-Za-z0-9 ])", r"\\\1", pattern)


def _first_place(patterns: dict[str, int], found: Column) -> Column:
    """The least place of the found patterns."""
    places = F.create_map(*(F.lit(x) for pair in patterns.items() for x in pair))
    return F.array_min(F.transform(found, lambda p: F.element_at(places, p)))


def first_rule(text: Column, rules: list[Rule]) -> Column:
    """The place of the first rule that holds for a text, or null.

    At each sign the patterns that stand there are tried in the order of their rules, so that a scan sees each place's
    first rule, and the least of them is the text's. A longer pattern behind its own beginning isn't needed: its rule
    comes later.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    starts, contains = {}, {}
    for i, rule in enumerate(rules):
        if rule.kind not in ("starts", "contains") or not rule.pattern:
            raise ValueError(f"no such rule: {rule}")
        held = starts if rule.kind == "starts" else contains
        held.setdefault(rule.pattern if rule.kind == "starts" else rule.pattern.lower(), i)
    scan = lambda where, anchor, patterns: F.array_distinct(F.regexp_extract_all(where, F.lit(f"{anchor}(?=({'|'.join(map(_quoted, patterns))}))"), F.lit(1)))
    text = F.coalesce(text, F.lit(""))
    places = [_first_place(p, scan(w, a, p)) for w, a, p in ((text, r"\A", starts), (F.lower(text), "", contains)) if p]
    return F.array_min(F.array(*places)) if places else F.lit(None).cast("int")


def role_of(text: Column, rules: list[Rule], default: str, exceptions: dict[str, tuple[tuple[str, ...], str]] | None = None) -> Column:
    """The role that the first rule gives a text, or default; exceptions: role -> (patterns, the role that texts with one of them have in its place). Empty texts have the default of empty ones: that of no rule."""
    roles = F.array(*(F.lit(r.role) for r in rules)) if rules else F.array().cast("array<string>")
    found = F.coalesce(F.get(roles, first_rule(text, rules)), F.lit(default))
    low, out = F.lower(F.coalesce(text, F.lit(""))), found
    for role, (patterns, other) in (exceptions or {}).items():
        some = F.lit(False)
        for p in patterns:
            some = some | low.contains(p.lower())
        out = F.when((found == role) & some, other).otherwise(out)
    return out


def _mapped(values: dict[str, str], role: Column, default: str) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), role), F.lit(default))


def inferred(role: Column, text: Column, negated: tuple[str, ...], metadata: Column) -> Column:
    """struct(operative_status, relation, answer_relevant) from a text's role and words; metadata: whether it is a title or metadata alone."""
    low = F.lower(F.coalesce(text, F.lit("")))
    denies = F.lit(False)
    for p in negated:
        denies = denies | low.contains(p.lower())
    status = F.when(role.isin("LIMITATION", "CLAIM") & denies, "NEGATED").otherwise(_mapped(STATUS, role, "DESCRIPTIVE"))
    relation = F.when((role == "LIMITATION") & denies, "limits")
    for of, words in RELATION_WORDS.items():
        for word, said in words:
            relation = relation.when((role == of) & low.contains(word), said)
    relevant = F.when(role == "BACKGROUND", F.when(metadata, "NO").otherwise("MAYBE")).otherwise("YES")
    return F.struct(status.alias("operative_status"), relation.otherwise(_mapped(RELATION, role, "asserts")).alias("relation"), relevant.alias("answer_relevant"))
