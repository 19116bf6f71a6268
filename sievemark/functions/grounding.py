"""Whether an answer is grounded in its source: entities, quantities, citations and shared content, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .elements import element

#: The token patterns and the words that don't count as content.
CITATION = r"\[[0-9A-Za-z_.:-]+\]"
TOKENS = rf"{CITATION}|[A-Za-z][A-Za-z0-9_-]*|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]+(?:\.[0-9]+)?"
CONTENT = r"[A-Za-z][A-Za-z0-9_-]*|[0-9]+(?:\.[0-9]+)?"
STOP = "a an and are as at be by for from in is it of on or that the this to with".split()


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({pattern})"), F.lit(1))


def claims(answer: Column) -> Column:
    """The checkable tokens of an answer, each once: array of struct(token, element), citations left out."""
    plain = F.array_distinct(F.filter(_all(answer, TOKENS), lambda k: ~k.startswith("[")))
    return F.filter(F.transform(plain, lambda k: F.struct(k.alias("token"), element(k).alias("element"))), lambda x: x["element"].isin("ENTITY", "NUMBER", "DATE"))


def content(text: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(_all(text, CONTENT), F.lower), lambda k: (F.length(k) > 2) & ~k.isin(*STOP)))


def check(answer: Column, source: Column, keys: Column | None = None, require_citation: bool = True) -> Column:
    """struct(verdict, reason, missing_entities, missing_quantities). Support is by substring of the lower-cased source; an answer without anything to check is UNCHECKABLE.

    keys: an array of names of sources; naming one counts as a citation.
    """
    # Tagging tokens and finding content is the work: each is done once.
    parts = F.struct(claims(answer).alias("found"), F.lower(F.coalesce(source, F.lit(""))).alias("low"), F.arrays_overlap(content(answer), content(source)).alias("shared"))
    return F.element_at(F.transform(F.array(parts), lambda p: _checked(answer, p["found"], p["low"], p["shared"], keys, require_citation)), 1)


def _checked(answer: Column, found: Column, low: Column, shared: Column, keys: Column | None, require_citation: bool) -> Column:
    missing = lambda kinds: F.transform(F.array_sort(F.transform(F.filter(found, lambda x: x["element"].isin(*kinds) & ~F.contains(low, F.lower(x["token"]))), lambda x: F.struct(F.lower(x["token"]).alias("low"), x["token"].alias("token")))), lambda x: x["token"])
    entities, quantities = missing(["ENTITY"]), missing(["NUMBER", "DATE"])
    named = F.exists(keys, lambda k: (k != "") & F.contains(F.lower(answer), F.lower(k))) if keys is not None else F.lit(False)
    cited = F.coalesce(answer, F.lit("")).rlike(CITATION) | F.coalesce(named, F.lit(False))
    reasons = [
        F.when(F.size(entities) > 0, F.concat(F.lit("missing entities: "), F.array_join(entities, ", "))), F.when(F.size(quantities) > 0, F.concat(F.lit("missing numbers/dates: "), F.array_join(quantities, ", "))),
        F.when(~cited, "missing citation marker") if require_citation else F.lit(None).cast("string"), F.when(~shared, "no non-trivial evidence overlap"),
    ]
    failed = F.array_compact(F.array(*reasons))
    nothing = F.size(found) == 0
    verdict = F.when(nothing, "UNCHECKABLE").when(F.size(failed) > 0, "RULED_OUT_WRONG").otherwise("NOT_RULED_OUT")
    reason = F.when(nothing, "no checkable entities, numbers, or dates in answer").when(F.size(failed) > 0, F.array_join(failed, "; ")).otherwise("answer is grounded in source")
    return F.struct(verdict.alias("verdict"), reason.alias("reason"), F.when(nothing, F.array().cast("array<string>")).otherwise(entities).alias("missing_entities"), F.when(nothing, F.array().cast("array<string>")).otherwise(quantities).alias("missing_quantities"))
