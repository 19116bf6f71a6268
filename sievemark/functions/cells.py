"""Cells that hold several items. The delimiter, the case and the trimming are part of each contract."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(cell: Column) -> Column:
    return F.coalesce(cell.cast("string"), F.lit(""))


def _items(text: Column, pattern: str, lower: bool = False) -> Column:
    parts = F.transform(F.split(text, pattern), lambda x: F.lower(F.trim(x)) if lower else F.trim(x))
    return F.filter(parts, lambda x: x != "")


def listed(cell: Column) -> Column:
    """The items of a JSON list, as strings, or null where the cell is none."""
    return F.when(F.trim(_text(cell)).rlike(r"^\[[\s\S]*\]$"), F.from_json(F.trim(_text(cell)), "array<string>"))


def piped_lower(cell: Column) -> Column:
    """Set of lower-cased items between bars; a missing cell is empty."""
    return F.array_distinct(_items(_text(cell), r"\|", lower=True))


def piped_as_written(cell: Column) -> Column:
    """Set of items between bars as they are written, spaces too; empty items and the word nan go."""
    return F.array_distinct(F.filter(F.split(_text(cell), r"\|"), lambda x: (x != "") & (F.lower(x) != "nan")))


def semicolon_lower(cell: Column) -> Column:
    """Set of lower-cased items between semicolons."""
    return F.array_distinct(_items(_text(cell), ";", lower=True))


def semicolon_canonical(cell: Column, synonyms: dict[str, str]) -> Column:
    """Set of items between semicolons, each under its canonical name."""
    names = F.create_map(*(F.lit(x) for pair in synonyms.items() for x in pair)) if synonyms else None
    return F.array_distinct(F.transform(_items(_text(cell), ";", lower=True), lambda x: F.coalesce(F.element_at(names, x), x) if names is not None else x))


def list_or_separated(cell: Column) -> Column:
    """Items of a JSON list, else between semicolons if there are any, else between commas."""
    text = _text(cell)
    cleaned = F.filter(F.transform(listed(cell), lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")
    return F.coalesce(cleaned, F.when(text.contains(";"), _items(text, ";")).otherwise(_items(text, ",")))


def with_format(cell: Column) -> Column:
    """struct(items, format): a JSON list, else parts by the first of semicolon, bar and newline that occurs, else a single item or none."""
    text = _text(cell)
    cleaned = F.filter(F.transform(listed(cell), lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")
    made = lambda items, name: F.struct(items.alias("items"), F.lit(name).alias("format"))
    return (
        F.when(F.trim(text) == "", made(F.array().cast("array<string>"), "empty")).when(listed(cell).isNotNull(), made(cleaned, "json_list")).when(text.contains(";"), made(_items(text, ";"), "semicolon"))
        .when(text.contains("|"), made(_items(text, r"\|"), "pipe")).when(text.contains("\n"), made(_items(text, "\n"), "newline")).otherwise(made(F.array(F.trim(text)), "single"))
    )


def phrases(cell: Column) -> Column:
    """Items between bars or semicolons, in order, repeats kept."""
    return _items(_text(cell), "[|;]")


def ordered_distinct(cell: Column) -> Column:
    """Items of a JSON list or between semicolons, each once, in order."""
    cleaned = F.filter(F.transform(listed(cell), lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")
    return F.array_distinct(F.coalesce(cleaned, _items(_text(cell), ";")))


def jaccard(a: Column, b: Column, of_empty: float) -> Column:
    """Common over all items of two sets; of_empty is the value of two empty ones, on which contracts differ."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(of_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def normal_name(item: Column) -> Column:
    """An entity's name to compare by: lower case, signs as spaces, each word without a plural s (words over three letters)."""
    words = F.filter(F.split(F.regexp_replace(F.lower(item), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.when((F.length(w) > 3) & w.endswith("s"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)), " ")


def singular_name(item: Column) -> Column:
    """The other form: a last ies becomes y, else a last s goes that no s stands before."""
    low = F.trim(F.lower(item))
    return F.when(low.endswith("ies") & (F.length(low) > 4), F.concat(F.substring(low, F.lit(1), F.length(low) - 3), F.lit("y"))).when(low.endswith("s") & ~low.endswith("ss") & (F.length(low) > 3), F.substring(low, F.lit(1), F.length(low) - 1)).otherwise(low)


def in_order(items: Column, order: list[str]) -> Column:
    """Items in a canonical order; those that it doesn't name come last, by name."""
    place = lambda x: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), x), F.lit(0)), F.lit(len(order) + 1))
    return F.transform(F.array_sort(F.transform(items, lambda x: F.struct(place(x).alias("place"), x.alias("item")))), lambda s: s["item"])
