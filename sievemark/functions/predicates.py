"""Row predicates and derived cells of evaluation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def yes(cell: Column, blank: bool = False) -> Column:
    """Whether a cell says YES; blank: whether an empty or missing one counts as well (contracts differ)."""
    text = F.upper(F.trim(F.coalesce(cell.cast("string"), F.lit(""))))
    return text.isin("YES", "") if blank else text == "YES"


def included(df: DataFrame, column: str, blank: bool = False) -> Column:
    """yes() of a column that a table may lack; an absent column includes every row."""
    return yes(F.col(column), blank) if column in df.columns else F.lit(True)


def outside(cell: Column, labels: tuple[str, ...]) -> Column:
    """Whether a label isn't of the domain (a missing one isn't either)."""
    return ~F.coalesce(cell.isin(*labels), F.lit(False))


def contains_any(text: Column, parts: tuple[str, ...]) -> Column:
    low, some = F.lower(F.coalesce(text, F.lit(""))), F.lit(False)
    for p in parts:
        some = some | low.contains(p)
    return some


def starts_with_any(text: Column, parts: tuple[str, ...]) -> Column:
    low, some = F.ltrim(F.lower(F.coalesce(text, F.lit("")))), F.lit(False)
    for p in parts:
        some = some | low.startswith(p)
    return some


def has_phrase(text: Column, phrase: str) -> Column:
    """Whether a phrase stands between signs that are no letters or digits; its spaces match any white space."""
    body = r"\s+".join("".join(f"\\{c}" if not c.isalnum() else c for c in w) for w in phrase.lower().split())
    return F.lower(text).rlike(f"(?<![a-z0-9]){body}(?![a-z0-9])")


#: Keys and words of outputs that are errors.
ERROR_KEYS = ("error", "exception", "connection_error", "provider_error", "status_code", "traceback")
ERROR_WORDS = ("connection refused", "max retries", "econnrefused", "failed to connect", "provider error", "httpconnectionpool", "traceback")


def error_like(output: Column) -> Column:
    """Whether an output looks like an error: a JSON object with an error key, or error words."""
    keys = F.array(*map(F.lit, ERROR_KEYS))
    return F.coalesce(F.arrays_overlap(F.json_object_keys(output), keys), F.lit(False)) | contains_any(output, ERROR_WORDS)


def title_like(text: Column, starts: tuple[str, ...] = ("title:", "author:", "date:", "abstract"), words: tuple[str, ...] = ("all rights reserved", "table of contents")) -> Column:
    return starts_with_any(text, starts) | contains_any(text, words)


def markers(text: Column, banned: tuple[str, ...]) -> Column:
    """The banned markers that a text holds."""
    return F.filter(F.array(*map(F.lit, banned)), lambda m: F.contains(F.lower(text), m))


def failed(final_status: Column, verdict: Column) -> Column:
    return final_status.isin("rejected", "escalated", "repaired") | (verdict == "RULED_OUT_WRONG")


def false_accept(record: Column, final_status: Column) -> Column:
    """Whether an accepted decision's JSON record says that the answer was known to be wrong."""
    known = F.try_variant_get(F.try_parse_json(record), "$.known_wrong", "boolean")
    return F.coalesce(known, F.lit(False)) & (final_status == "accepted")


def without_heading(text: Column, names: tuple[str, ...]) -> Column:
    """The text without a leading heading of a role's name."""
    return F.regexp_replace(text, rf"^###\s*(?:{'|'.join(names)})\b[:\s]*", "")


def filled(cell: Column, rule: Column) -> Column:
    """The cell, or the rule's value where it is empty."""
    return F.when(F.trim(F.coalesce(cell, F.lit(""))) == "", rule).otherwise(cell)


def first_integer(text: Column) -> Column:
    """The first signed integer, else 0."""
    return F.coalesce(F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), "([+-]?[0-9]+)", 1), F.lit("")).cast("long"), F.lit(0).cast("long"))
