"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The token patterns (portable forms for Spark and for SQL engines with RE2).
ROUTE_TOKENS = r"https?://\S+|\[[0-9]+\]|[A-Za-z]+|[0-9]+|[^A-Za-z0-9_\s\x{80}-\x{10FFFF}]"
TERM_TOKENS = r"[A-Za-z0-9]+(?:'[A-Za-z]+)?"
WORD_TOKENS = r"[a-zA-Z0-9_]+"


def extract_all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({pattern})"), F.lit(1))


def route_tokens(text: Column) -> Column:
    """Tokens in order: links, bracketed numbers, words, numbers, single signs."""
    return extract_all(text, ROUTE_TOKENS)


def terms(text: Column) -> Column:
    """Lower-cased terms for weighting."""
    return F.transform(extract_all(text, TERM_TOKENS), F.lower)


def keywords(text: Column, stop: tuple[str, ...] = ()) -> Column:
    """Lower-cased words of two letters or more without stop words; hyphens count as underscores."""
    words = extract_all(F.lower(F.replace(text, F.lit("-"), F.lit("_"))), WORD_TOKENS)
    return F.filter(words, lambda w: (F.length(w) > 1) & (~w.isin(*stop) if stop else F.lit(True)))


def singular(token: Column) -> Column:
    """Lower case without outer punctuation and without one trailing s (words over three letters, not after another s)."""
    bare = F.lower(F.regexp_replace(token, r"^[\p{Punct}]+|[\p{Punct}]+$", ""))
    return F.when((F.length(bare) > 3) & bare.endswith("s") & ~bare.endswith("ss"), F.substring(bare, F.lit(1), F.length(bare) - 1)).otherwise(bare)


def token_class(token: Column) -> Column:
    """An ordered rule chain; the order is the meaning."""
    low = F.lower(token)
    return (
        F.when(token.rlike("^https?://"), "link").when(token.rlike(r"^\[[0-9]+\]$"), "citation").when(token.rlike("^[0-9]+$"), "number")
        .when(token.rlike("^[^A-Za-z0-9]$"), "punctuation").when(low.isin("not", "no", "never", "without", "nor"), "negation")
        .when(low.isin("must", "should", "may", "can", "shall", "will", "might"), "modal").when(low.isin("the", "a", "an", "of", "to", "in", "and", "or", "is", "are", "was", "be", "by", "for", "on", "with", "it", "that", "this"), "function")
        .when(token.rlike("^[A-Z][A-Z]+$"), "acronym").when(token.rlike("^[A-Z]"), "proper").otherwise("content")
    )


#: The weight of each token class.
CLASS_WEIGHTS = {"link": 0.8, "citation": 0.8, "number": 0.9, "punctuation": 0.05, "negation": 1.0, "modal": 0.7, "function": 0.1, "acronym": 0.85, "proper": 0.8, "content": 0.5}


def class_weight(kind: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in CLASS_WEIGHTS.items() for x in pair)), kind)


def entities(cell: Column, delimiter: str = "|", lower: bool = True) -> Column:
    """A delimited cell as an array of distinct trimmed items; empty and literal nan items go."""
    items = F.transform(F.split(F.coalesce(cell, F.lit("")), f"[{delimiter}]"), F.trim)
    kept = F.filter(F.transform(items, F.lower) if lower else items, lambda x: (x != "") & (F.lower(x) != "nan"))
    return F.array_distinct(kept)


def overlap_score(query: Column, doc: Column) -> Column:
    """Common distinct tokens over the root of the query's."""
    return F.size(F.array_intersect(query, doc)) / (F.sqrt(F.size(F.array_distinct(query))) + 1e-9)


def clip(text: Column, n: int) -> Column:
    """White space collapsed, cut to n characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n - 3), F.lit("..."))).otherwise(flat)


def answer_integer(text: Column) -> Column:
    """The integer after an answer key, else the next one behind an answer label that no digit follows at once, else the last one; commas are dropped; null if there is none."""
    value = F.coalesce(text, F.lit(""))
    # Up to the last digit, so that the first label that counts always has an integer behind it.
    upto = F.reverse(F.regexp_replace(F.reverse(value), "^[^0-9]*+", ""))
    key = F.regexp_extract(value, r'(?i)"answer"\s*:\s*"?(-?[0-9][0-9,\s]*)', 1)
    label = F.regexp_extract(upto, r"(?i)(?:answer|final)(?![0-9])[^0-9]*?(-?[0-9][0-9,]*)", 1)
    last = F.try_element_at(F.regexp_extract_all(value, F.lit("(-?[0-9][0-9,]*)"), F.lit(1)), F.lit(-1))
    return F.regexp_replace(F.coalesce(F.nullif(key, F.lit("")), F.nullif(label, F.lit("")), last), r"[,\s]", "")


def unsafe_path(path: Column) -> Column:
    """Parent steps, absolute paths, drive letters and home shortcuts."""
    flat = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.array_contains(F.split(flat, "/"), "..") | flat.startswith("/") | flat.startswith("~") | flat.rlike("^[A-Za-z]:")
