"""Queries: one-sided checkers and the decisions made of them."""

from __future__ import annotations

from functools import reduce
from math import prod

from pyspark.sql import functions as F

from ..functions import digital as D
from ..functions import numbers as N
from ..functions import text as T
from .query import query

_CLAIM = "l_orderkey * l_partkey + CASE l_linenumber % 4 WHEN 1 THEN 1 WHEN 2 THEN 33666633 WHEN 3 THEN 99 ELSE 0 END"
_DIFFERS = " OR ".join(f"(l_orderkey % {m}) * (l_partkey % {m}) % {m} <> ({_CLAIM}) % {m}" for m in N.MODULI)


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN {_DIFFERS} THEN 'RULED_OUT_WRONG' ELSE 'NOT_RULED_OUT' END AS verdict, l_linenumber % 4 <> 0 AS wrong FROM lineitem")
def residue_verdicts(t):
    """Claimed products checked by residues; an error that is a multiple of all moduli can't be ruled out."""
    error = F.when(F.col("l_linenumber") % 4 == 1, 1).when(F.col("l_linenumber") % 4 == 2, 33666633).when(F.col("l_linenumber") % 4 == 3, 99).otherwise(0)
    claim = (F.col("l_orderkey") * F.col("l_partkey") + error).cast("string")
    folded = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", D.digits_residue(claim, prod(N.MODULI)).alias("r"))
    differs = reduce(lambda a, b: a | b, ((F.col("l_orderkey") % m) * (F.col("l_partkey") % m) % m != F.col("r") % m for m in N.MODULI))
    return folded.select("l_orderkey", "l_linenumber", F.when(differs, "RULED_OUT_WRONG").otherwise("NOT_RULED_OUT").alias("verdict"), (F.col("l_linenumber") % 4 != 0).alias("wrong"))


_BANKS = {"nine": (9,), "small": (7, 9, 11), "default": (7, 9, 11, 13, 37, 101), "wide": (7, 9, 11, 13, 37, 101, 41, 43)}
_BANK_SQL = " UNION ALL ".join(f"SELECT '{b}' AS bank, {' OR '.join(f'off % {m} <> 0' for m in ms)} AS caught, off FROM x" for b, ms in _BANKS.items())


@query(f"WITH x AS (SELECT l_orderkey * 7 + l_partkey * 11 + l_linenumber * 13 + 1 AS off FROM lineitem) SELECT bank, count(*) AS checks, count(*) FILTER (WHERE caught) AS ruled_out, count(*) FILTER (WHERE NOT caught) AS escaped, round(count(*) FILTER (WHERE caught)::DOUBLE / count(*), 6) AS catch_rate FROM ({_BANK_SQL}) GROUP BY 1")
def bank_sensitivity(t):
    """Every error offset against every modulus bank, in one pass; counts are taken before any shuffle."""
    off = t.lineitem.select((F.col("l_orderkey") * 7 + F.col("l_partkey") * 11 + F.col("l_linenumber") * 13 + 1).alias("off"))

    def caught(ms):
        some = F.lit(False)
        for m in ms:
            some = some | (F.col("off") % m != 0)
        return some

    counts = off.agg(F.count("*").alias("checks"), *(F.count_if(caught(ms)).alias(b) for b, ms in _BANKS.items()))
    long = counts.select("checks", F.explode(F.array(*(F.struct(F.lit(b).alias("bank"), F.col(b).alias("ruled_out")) for b in _BANKS))).alias("x"))
    return long.select("x.bank", "checks", "x.ruled_out", (F.col("checks") - F.col("x.ruled_out")).alias("escaped"), F.round(F.col("x.ruled_out") / F.col("checks"), 6).alias("catch_rate"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey = 0 THEN 0 ELSE 1 + (o_orderkey - 1) % 9 END AS root, (o_orderkey * 1000003 + o_custkey) % 101 AS residue_101 FROM orders")
def digital_roots(t):
    digits = (F.col("o_orderkey") * 1000003 + F.col("o_custkey")).cast("string")
    return t.orders.select("o_orderkey", N.digital_root(F.col("o_orderkey")).cast("long").alias("root"), N.digits_mod(digits, 101).alias("residue_101"))


_K = "json_extract(props, '$.k')"


@query(f"""
SELECT event_id, CASE WHEN NOT json_valid(props) THEN 'RULED_OUT_WRONG' WHEN {_K} IS NULL OR json_type(props, '$.k') NOT IN ('BIGINT', 'UBIGINT') THEN 'RULED_OUT_WRONG' WHEN CAST({_K} AS BIGINT) < 10 OR CAST({_K} AS BIGINT) > 90 THEN 'RULED_OUT_WRONG' ELSE 'NOT_RULED_OUT' END AS verdict,
       CASE WHEN NOT json_valid(props) THEN 'invalid json' WHEN {_K} IS NULL THEN 'missing k' WHEN json_type(props, '$.k') NOT IN ('BIGINT', 'UBIGINT') THEN 'k is not an integer' WHEN CAST({_K} AS BIGINT) < 10 THEN 'k below minimum' WHEN CAST({_K} AS BIGINT) > 90 THEN 'k above maximum' ELSE '' END AS reason FROM events""")
def json_schema_verdicts(t):
    """A schema known when the query is built, compiled to one ordered condition; the first error counts."""
    v = F.try_parse_json("props")
    k, kind = F.try_variant_get(v, "$.k", "long"), F.schema_of_variant(F.try_variant_get(v, "$.k", "variant"))
    reason = F.when(v.isNull(), "invalid json").when(F.try_variant_get(v, "$.k", "variant").isNull(), "missing k").when(kind != "BIGINT", "k is not an integer").when(k < 10, "k below minimum").when(k > 90, "k above maximum").otherwise("")
    return t.events.select("event_id", F.when(reason != "", "RULED_OUT_WRONG").otherwise("NOT_RULED_OUT").alias("verdict"), reason.alias("reason"))


@query(r"""
WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN '../' || regexp_replace(url, '^https?://', '') WHEN 1 THEN '/' || url WHEN 2 THEN 'C:\' || url ELSE regexp_replace(url, '^https?://', '') END AS path FROM pages)
SELECT page_id, list_contains(string_split(replace(path, '\', '/'), '/'), '..') OR starts_with(replace(path, '\', '/'), '/') OR starts_with(path, '~') OR regexp_matches(replace(path, '\', '/'), '^[A-Za-z]:') AS unsafe FROM p""")
def unsafe_paths(t):
    bare = F.regexp_replace("url", "^https?://", "")
    path = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("../"), bare)).when(F.col("page_id") % 5 == 1, F.concat(F.lit("/"), F.col("url"))).when(F.col("page_id") % 5 == 2, F.concat(F.lit("C:\\"), F.col("url"))).otherwise(bare)
    return t.pages.select("page_id", T.unsafe_path(path).alias("unsafe"))


_CONTENT = "list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda x: length(x) > 2))"


@query(f"""
WITH x AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS src FROM conversations), y AS (SELECT conv_id, turn, {_CONTENT.format(c='text')} AS a, src FROM x WHERE src IS NOT NULL),
z AS (SELECT conv_id, turn, len(a) AS n, len(list_filter(a, lambda w: contains(lower(src), w))) AS supported FROM y)
SELECT conv_id, turn, n, supported, CASE WHEN n = 0 THEN 'UNCHECKABLE' WHEN supported * 2 < n THEN 'RULED_OUT_WRONG' ELSE 'NOT_RULED_OUT' END AS verdict FROM z""")
def grounding_verdicts(t):
    """A turn's content words must occur in the turn before it (as substrings of its lower-cased text)."""
    from pyspark.sql import Window

    x = t.conversations.select("conv_id", "turn", "text", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("src")).filter("src IS NOT NULL")
    words = F.array_distinct(F.filter(T.extract_all(F.lower("text"), "[a-z0-9]+"), lambda w: F.length(w) > 2))
    y = x.select("conv_id", "turn", F.size(words).cast("long").alias("n"), F.size(F.filter(words, lambda w: F.contains(F.lower("src"), w))).cast("long").alias("supported"))
    verdict = F.when(F.col("n") == 0, "UNCHECKABLE").when(F.col("supported") * 2 < F.col("n"), "RULED_OUT_WRONG").otherwise("NOT_RULED_OUT")
    return y.withColumn("verdict", verdict)


@query("""
WITH v AS (SELECT event_id, event_type, CASE WHEN value < 20 THEN 'RULED_OUT_WRONG' WHEN value < 30 THEN 'UNCHECKABLE' ELSE 'NOT_RULED_OUT' END AS verdict, CASE WHEN event_id % 7 = 0 THEN 'high' ELSE 'low' END AS risk FROM events)
SELECT verdict, risk, CASE WHEN risk = 'high' THEN 'escalate' WHEN verdict = 'RULED_OUT_WRONG' THEN 'repair' WHEN verdict = 'UNCHECKABLE' THEN 'review' ELSE 'accept' END AS action, count(*) AS n,
       bool_and(verdict = 'RULED_OUT_WRONG' OR risk = 'high') AS blocking FROM v GROUP BY 1, 2, 3""")
def harness_decisions(t):
    """Verdict and risk to action; high risk escalates first, and nothing is dropped silently."""
    value = F.col("value")
    v = t.events.select(F.when(value < 20, "RULED_OUT_WRONG").when(value < 30, "UNCHECKABLE").otherwise("NOT_RULED_OUT").alias("verdict"), F.when(F.col("event_id") % 7 == 0, "high").otherwise("low").alias("risk"))
    action = F.when(F.col("risk") == "high", "escalate").when(F.col("verdict") == "RULED_OUT_WRONG", "repair").when(F.col("verdict") == "UNCHECKABLE", "review").otherwise("accept")
    return v.groupBy("verdict", "risk", action.alias("action")).agg(F.count("*").alias("n"), F.bool_and((F.col("verdict") == "RULED_OUT_WRONG") | (F.col("risk") == "high")).alias("blocking"))


_SAID = """text || CASE turn % 4 WHEN 0 THEN ' {"answer": "1,' || conv_id || ' 7"}' WHEN 1 THEN ' final2: the final result that I get is -2' || conv_id || ', see page 7' WHEN 2 THEN ' Answer-' || conv_id || ' of 9' ELSE ' so 3' || conv_id || ' ' END"""


@query(rf"""
WITH x AS (SELECT conv_id, turn, {_SAID} AS s FROM conversations), y AS (SELECT *, regexp_extract(s, '(?i)(?:answer|final)[^0-9]+[0-9][0-9,]*') AS lab FROM x)
SELECT conv_id, turn, regexp_replace(coalesce(nullif(regexp_extract(s, '(?i)"answer"\s*:\s*"?(-?[0-9][0-9,\s]*)', 1), ''), nullif(CASE WHEN lab <> '' THEN regexp_extract(lab, '-?[0-9][0-9,]*$') END, ''), regexp_extract_all(s, '-?[0-9][0-9,]*')[-1]), '[,\s]', '', 'g') AS answer FROM y""")
def answer_integers(t):
    """The integer that each output states: behind a key, behind a label with a gap, or the last one."""
    return t.conversations.select("conv_id", "turn", T.answer_integer(F.expr(_SAID)).alias("answer"))


@query(r"""
SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[0-9]+\s*[*+^]\s*[0-9]+') THEN 'arithmetic' WHEN contains(text, '{') THEN 'json' WHEN regexp_matches(text, '(?i)\b(def|class|import)\b') THEN 'code' WHEN contains(text, '?') THEN 'question' WHEN length(text) > 200 THEN 'long_context' ELSE 'text' END AS task FROM conversations""")
def task_classes(t):
    x = F.col("text")
    task = F.when(x.rlike(r"[0-9]+\s*[*+^]\s*[0-9]+"), "arithmetic").when(x.contains("{"), "json").when(x.rlike(r"(?i)\b(def|class|import)\b"), "code").when(x.contains("?"), "question").when(F.length(x) > 200, "long_context").otherwise("text")
    return t.conversations.select("conv_id", "turn", task.alias("task"))
