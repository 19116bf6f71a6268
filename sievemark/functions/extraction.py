"""What model output holds: code and JSON objects."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: How prose around code begins, and how its end is announced.
LEADS, ENDS = ("here is", "sure", "below is", "the code"), ("explanation:", "note:")
SYSTEM_PREFIXES = ("/etc/", "/bin/", "/usr/", "/var/", "/root/", "c:\\windows", "c:\\users")


def code(output: Column) -> Column:
    """The first fenced block, else the lines without prose before and after them if they look like code; null if there is none."""
    text = F.coalesce(output, F.lit(""))
    fence = r"(?s)```(?i:python|py)?\s*(.*?)```"
    lines = F.transform(F.split(F.trim(text), r"\r?\n"), lambda x: F.struct(x.alias("line"), F.lower(F.trim(x)).alias("low")))
    starts = lambda x, words: [x.startswith(w) for w in words]
    any_of = lambda conditions: F.array_contains(F.array(*conditions), F.lit(True))
    led = F.coalesce(F.get(F.filter(F.transform(lines, lambda x, i: F.when(~any_of(starts(x["low"], LEADS)), i)), lambda i: i.isNotNull()), F.lit(0)), F.size(lines))
    ended = F.coalesce(F.get(F.filter(F.transform(lines, lambda x, i: F.when((i >= led) & any_of(starts(x["low"], ENDS)), i)), lambda i: i.isNotNull()), F.lit(0)), F.size(lines))
    plain = F.trim(F.array_join(F.transform(F.slice(lines, led + 1, ended - led), lambda x: x["line"]), "\n"), F.lit(" \n\t"))
    looks = plain.rlike("(?:def|class|import|from|return|for|while|if) |=")
    return F.when(text.rlike(fence), F.nullif(F.trim(F.regexp_extract(text, fence, 1), F.lit(" \n\t")), F.lit(""))).when(looks, plain)


def _let(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


_BLOCK = 256


def _before(values: Column, at: Column) -> Column:
    """at, and at with each value added in turn."""
    return F.aggregate(values, F.array(at), lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + x)))


def running(values: Column) -> Column:
    """The sum of the integers before each one, in blocks, so that the work stays near their number."""
    cut = lambda n: F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / _BLOCK).cast("int")), lambda i: F.slice(n, i * _BLOCK + 1, F.lit(_BLOCK)))
    begins = lambda blocks: _before(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x)), F.lit(0))
    joined = lambda blocks: _let(begins(blocks), lambda at: F.flatten(F.transform(blocks, lambda b, i: F.slice(_before(b, F.get(at, i)), 1, F.size(b)))))
    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(_let(values, lambda n: _let(cut(n), joined)))


def is_json_object(text: Column) -> Column:
    """Whether a text that begins with a brace and ends with its partner is a JSON object; NaN and infinities are numbers."""
    plain = F.when(text.rlike("NaN|Infinity"), F.regexp_replace(text, r"(?<=[:\[,\s])-?(?:NaN|Infinity)(?=[\s,}\]])", "0")).otherwise(text)
    return F.json_object_keys(plain).isNotNull()


def _balanced(text: Column) -> Column:
    """Of each brace that may begin an object and has a partner: struct(pos, length), by pos.

    Quotes behind an even number of backslashes open and close strings. Seen from a brace, those that have as many
    quotes before them, modulo 2, stand outside strings; so braces fall into two classes, and inside a class a brace's
    partner is the next closing sign of its level.
    """
    tokens = F.regexp_extract_all(text, F.lit(r"(\\++\"?|[\"{}\[\]]|[^\\\"{}\[\]]++)"), F.lit(1))
    is_quote = lambda x: x.endswith('"') & (F.length(x) % 2 == 1)
    first = lambda x: F.substring(x, 1, 1)
    goes_on = lambda k, i: F.coalesce(F.get(k, i + 1).isin('"', "}") | (F.get(k, i + 1).rlike(r"^\s+$") & F.get(k, i + 2).isin('"', "}")), F.lit(False))

    def marks(k: Column) -> Column:
        quotes = running(F.transform(k, lambda x: is_quote(x).cast("int")))
        places = running(F.transform(k, F.length))
        of = lambda q, p: F.filter(F.transform(k, lambda x, i: F.struct(F.get(q, i).alias("quotes"), F.get(p, i).alias("pos"), x.alias("sign"), (first(x) == "{").__and__(goes_on(k, i)).alias("begins"))), lambda m: m["sign"].isin("{", "}", "[", "]"))
        return _let(quotes, lambda q: _let(places, lambda p: of(q, p)))

    def paired(m: Column) -> Column:
        step = lambda x: F.when(x["sign"].isin("{", "["), 1).otherwise(-1)
        levels = lambda at: F.transform(m, lambda x, i: F.struct((F.get(at, i) + F.when(step(x) > 0, 1).otherwise(0)).alias("level"), x["pos"].alias("pos"), x["sign"].alias("sign"), x["begins"].alias("begins")))
        ordered = lambda s: F.transform(s, lambda x, i: F.when(x["begins"] & (F.get(s, i + 1)["level"] == x["level"]) & (F.get(s, i + 1)["sign"] == "}"), F.struct(x["pos"].alias("pos"), (F.get(s, i + 1)["pos"] - x["pos"] + 1).alias("length"))))
        return F.array_compact(_let(running(F.transform(m, step)), lambda at: _let(F.array_sort(levels(at)), ordered)))

    side = lambda m, n: paired(F.filter(m, lambda x: x["quotes"] % 2 == n))
    return _let(tokens, lambda k: _let(marks(k), lambda m: F.array_sort(F.concat(side(m, 0), side(m, 1)))))


#: A brace that may begin an object (no parser takes one without a name and a colon, or a closing brace, behind it), and what stands behind one up to its partner where no other brace, bracket or backslash is outside of strings.
_BEGINS, _PLAIN_REST = r"\{(?=\s*+(?:\}|\"(?:[^\\\"]++|\\(?s:.))*+\"\s*+:))", r"(?:[^\\\"{}\[\]]++|\"[^\\\"]*+\")*+\}"


def _plain_first(text: Column) -> Column:
    """The first of the braces that may begin an object which parses as a plain one, or "{" where one comes first that isn't plain; null if there is neither.

    A plain object's partner is the next closing brace outside of strings, as _balanced() finds it. Every brace is
    looked at, also inside what begins at an earlier one; a look ends at the next sign, so that the work stays near the
    text's length.
    """
    rests = F.regexp_extract_all(text, F.lit(rf"{_BEGINS}(?=({_PLAIN_REST})?)"), F.lit(1))
    return F.aggregate(rests, F.lit(None).cast("string"), lambda done, r: F.when(done.isNotNull(), done).when(r == "", "{").otherwise(_let(F.concat(F.lit("{"), r), lambda s: F.when(is_json_object(s), s))))


def json_object(output: Column) -> Column:
    """The first JSON object in a text as it is written; null if there is none.

    That is what the first fence with a brace behind it holds up to the next fence behind a closing brace, if it parses;
    else the first that parses of those that begin at a brace with a quote or a closing brace behind it. One scan of the
    text finds all of them; it is left out where plain objects decide.
    """
    text = F.coalesce(output, F.lit(""))
    fence = r"```(?i:json)?\s*+\{"
    behind = F.substring(text, F.regexp_instr(text, F.lit(fence)), F.length(text))
    fenced = F.when(text.contains("```") & text.rlike(fence), F.regexp_extract(behind, r"(?s)\A```(?i:json)?\s*+(\{.*?\})\s*+```", 1))
    whole = lambda b: F.substring(text, b["pos"] + 1, b["length"])
    scanned = F.aggregate(_balanced(text), F.lit(None).cast("string"), lambda done, b: F.coalesce(done, _let(whole(b), lambda s: F.when(is_json_object(s), s))))
    plain = rf"\A{_BEGINS}{_PLAIN_REST}\z"
    partners = lambda s: F.when(s.rlike(plain), True).otherwise(F.exists(_balanced(s), lambda b: (b["pos"] == 0) & (b["length"] == F.length(s))))
    found = _let(fenced, lambda s: F.when((s != "") & partners(s) & is_json_object(s), s))
    behind_fence = F.when(text.contains("{"), _let(_plain_first(text), lambda p: F.when(p == "{", scanned).otherwise(p)))
    return F.coalesce(found, behind_fence)


@F.pandas_udf(StringType())
def canonical_json(raw: pd.Series) -> pd.Series:
    """JSON with sorted keys, without spaces, in ASCII; null where it doesn't parse. Spark's own writer keeps order and raw signs."""
    import json

    def one(s):
        try:
            return json.dumps(json.loads(s), ensure_ascii=True, sort_keys=True, separators=(",", ":"))
        except (TypeError, ValueError):
            return None

    return raw.map(one)


@F.pandas_udf(StringType())
def syntax_error(source: pd.Series) -> pd.Series:
    """Null where Python source parses (it is never run), else the error's name."""
    import ast
    import warnings

    def one(s):
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(s or "")
        except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
            return type(e).__name__
        return None

    return source.map(one)
