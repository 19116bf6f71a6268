"""Queries: derived fields, ordered buckets, variants, scorecards and number theory."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import matching as M
from ..operators import tables as J
from .evaluating import _GUESS, _LABELLED, _labelled
from .query import query
from .retrieving import _CLASS, _TOK, _WEIGHT


@query(f"SELECT gold, count(*) FILTER (WHERE pred = 0) AS pred_0, count(*) FILTER (WHERE pred = 1) AS pred_1 FROM ({_LABELLED}) GROUP BY 1")
def confusion_pivot(t):
    """The pivot names its values, so that no extra job looks for them."""
    wide = _labelled(t).groupBy("gold").pivot("pred", [0, 1]).count().na.fill(0)
    return wide.select("gold", F.col("0").alias("pred_0"), F.col("1").alias("pred_1"))


@query(f"""
WITH c AS (SELECT lang AS gold, {_GUESS} AS pred, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2)
SELECT gold, pred, n, rank FROM (SELECT *, row_number() OVER (ORDER BY n DESC, gold, pred) AS rank FROM c WHERE gold <> pred) WHERE rank <= 5""")
def top_error_pairs(t):
    """Counted first: the order is over at most labels x labels rows."""
    pairs = t.documents.filter("lang IS NOT NULL").groupBy(F.col("lang").alias("gold"), F.expr(_GUESS).alias("pred")).agg(F.count("*").alias("n"))
    return J.ranked(pairs.filter("gold <> pred").withColumn("one", F.lit(1)), ["one"], F.desc("n"), F.asc("gold"), F.asc("pred")).filter("rank <= 5").select("gold", "pred", "n", "rank")


_BUCKET = "CASE WHEN o_totalprice < 5000 THEN 'tiny' WHEN o_orderstatus = 'P' THEN 'partial' WHEN o_orderpriority LIKE '1-%' THEN 'urgent' WHEN o_totalprice > 200000 THEN 'large' ELSE 'ordinary' END"


@query(f"SELECT {_BUCKET} AS bucket, count(*) AS n, min(o_orderkey) AS first_key FROM orders GROUP BY 1")
def outcome_buckets(t):
    """Ordered rules; the first that holds names the bucket."""
    price = F.col("o_totalprice")
    bucket = F.when(price < 5000, "tiny").when(F.col("o_orderstatus") == "P", "partial").when(F.col("o_orderpriority").startswith("1-"), "urgent").when(price > 200000, "large").otherwise("ordinary")
    return t.orders.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


_SECOND = "CASE WHEN n_chars >= 500 THEN 1 ELSE 0 END"


@query(f"""
WITH x AS (SELECT gold, pred AS a, {_SECOND} AS b FROM ({_LABELLED})), v AS (
    SELECT 'first' AS variant, gold, a AS pred FROM x UNION ALL SELECT 'second', gold, b FROM x UNION ALL SELECT 'both', gold, least(a, b) FROM x
    UNION ALL SELECT 'guarded', gold, CASE WHEN a <> b AND a = 0 THEN b ELSE a END FROM x)
SELECT variant, count(*) AS n, round(avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM v GROUP BY 1""")
def field_variants(t):
    """All variants in one pass: each row is exploded into its prediction under every one."""
    a, b = F.col("pred"), F.when(F.col("n_chars") >= 500, 1).otherwise(0)
    chosen = {"first": a, "second": b, "both": F.least(a, b), "guarded": F.when((a != b) & (a == 0), b).otherwise(a)}
    each = _labelled(t).select("gold", F.explode(F.array(*(F.struct(F.lit(k).alias("variant"), v.alias("guess")) for k, v in chosen.items()))).alias("v")).select("gold", "v.*")
    return each.groupBy("variant").agg(F.count("*").alias("n"), F.round(F.avg((F.col("gold") == F.col("guess")).cast("double")), 6).alias("accuracy"))


@query("""
SELECT coalesce(nullif(trim(CASE WHEN turn % 3 = 0 THEN '' ELSE role END), ''), nullif(trim(CASE WHEN turn % 2 = 0 THEN ' ' ELSE 'odd' END), ''), 'unknown') AS key, count(*) AS n FROM conversations GROUP BY 1""")
def first_present_field(t):
    """Blank cells count as missing."""
    cells = [F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("role")), F.when(F.col("turn") % 2 == 0, " ").otherwise("odd")]
    return t.conversations.groupBy(F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in cells), F.lit("unknown")).alias("key")).agg(F.count("*").alias("n"))


@query(f"""
WITH k AS (SELECT conv_id, turn, unnest({_TOK.format(c='text')}) AS k, unnest(range(len({_TOK.format(c='text')}))) AS i FROM conversations), c AS (SELECT *, {_CLASS} AS class FROM k), s AS (SELECT *, {_WEIGHT} AS w FROM c)
SELECT conv_id, turn, coalesce(string_agg(k, ' ' ORDER BY i) FILTER (WHERE w >= 0.45), '') AS kept_text FROM s GROUP BY 1, 2""")
def compressed_turns(t):
    """The kept tokens of each turn in order, inside the row."""
    tokens = T.route_tokens(F.col("text"))
    kept = F.filter(tokens, lambda k: T.class_weight(T.token_class(k)) >= 0.45)
    return t.conversations.filter(F.size(tokens) > 0).select("conv_id", "turn", F.concat_ws(" ", kept).alias("kept_text"))


@query("""
WITH s AS (SELECT source, count(*) AS n, avg(n_chars) AS chars, count(DISTINCT lang) AS langs FROM documents GROUP BY 1)
SELECT source, n, array_to_string(list_filter([CASE WHEN n < 50 THEN 'few_rows' END, CASE WHEN chars < 1500 THEN 'short' END, CASE WHEN langs < 4 THEN 'few_languages' END], lambda x: x IS NOT NULL), '+') AS failed FROM s""")
def source_scorecard(t):
    s = t.documents.groupBy("source").agg(F.count("*").alias("n"), F.avg("n_chars").alias("chars"), F.count_distinct("lang").alias("langs"))
    failed = F.array_compact(F.array(F.when(F.col("n") < 50, "few_rows"), F.when(F.col("chars") < 1500, "short"), F.when(F.col("langs") < 4, "few_languages")))
    return s.select("source", "n", F.array_join(failed, "+").alias("failed"))


_BASES = (7, 9, 11, 13)


@query("SELECT o_orderkey, o_orderkey % 9009 AS value FROM orders")
def remainders_joined(t):
    """A number modulo 9009 out of its remainders modulo 7, 9, 11 and 13 (Chinese remainders)."""
    whole = reduce(lambda a, b: a * b, _BASES)
    parts = [(F.col("o_orderkey") % m) * (whole // m * pow(whole // m, -1, m)) for m in _BASES]
    return t.orders.select("o_orderkey", (reduce(lambda a, b: a + b, parts) % whole).alias("value"))


@query("""
WITH RECURSIVE r AS (SELECT p_partkey, p_size, 1 AS i, p_partkey % 1009 AS v FROM part UNION ALL SELECT p_partkey, p_size, i + 1, v * p_partkey % 1009 FROM r WHERE i < p_size)
SELECT p_partkey, p_size, v AS residue FROM r WHERE i = p_size""")
def power_residues(t):
    """p_partkey to the power of p_size modulo 1009 by squaring."""
    base, m = F.col("p_partkey") % 1009, 1009
    bits = F.array(*(F.lit(1 << k) for k in reversed(range(16))))
    value = F.aggregate(bits, F.lit(1).cast("long"), lambda a, b: F.when(F.col("p_size").bitwiseAND(b) > 0, a * a % m * base % m).otherwise(a * a % m))
    return t.part.filter("p_size >= 1").select("p_partkey", "p_size", value.alias("residue"))


@query("""
WITH RECURSIVE f AS (SELECT 0 AS n, 0::BIGINT AS a, 1::BIGINT AS b UNION ALL SELECT n + 1, b, (a + b) % 10007 FROM f WHERE n < 50)
SELECT p_partkey, a AS residue FROM part JOIN f ON f.n = p_size""")
def fibonacci_residues(t):
    step = lambda s, _: F.struct(s["b"].alias("a"), ((s["a"] + s["b"]) % 10007).alias("b"))
    begin = F.struct(F.lit(0).cast("long").alias("a"), F.lit(1).cast("long").alias("b"))
    return t.part.select("p_partkey", F.aggregate(F.sequence(F.lit(1), F.col("p_size")), begin, step)["a"].alias("residue"))


_DATE = "CASE WHEN o_orderkey % 7 = 0 THEN '2020-02-30' WHEN o_orderkey % 11 = 0 THEN 'soon' ELSE {d} END"


@query(f"SELECT o_orderkey, try_cast({_DATE.format(d='CAST(CAST(o_orderdate AS DATE) AS VARCHAR)')} AS DATE) IS NOT NULL AS valid FROM orders")
def date_checks(t):
    return t.orders.select("o_orderkey", F.expr(f"try_cast({_DATE.format(d='CAST(CAST(o_orderdate AS DATE) AS STRING)')} AS DATE) IS NOT NULL").alias("valid"))


@query(r"SELECT conv_id, turn, len(regexp_extract_all(text, '\[[0-9]+\]')) AS citations, len(regexp_extract_all(text, 'https?://\S+')) AS links FROM conversations")
def citation_counts(t):
    n = lambda p: F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0))).cast("long")
    return t.conversations.select("conv_id", "turn", n(r"\[[0-9]+\]").alias("citations"), n(r"https?://\S+").alias("links"))


@query()
def soft_entity_scores(t):
    """Greedy soft matching of the words of a part's name and type; greedy choice is sequential, so tests hold it against brute force."""
    g, p = F.split(F.lower("p_name"), " "), F.split(F.lower("p_type"), " ")
    n = F.size(F.col("m"))
    scored = t.part.select("p_partkey", g.alias("g"), p.alias("p"), M.greedy_matches(g, p, 0.3).alias("m"))
    return scored.select("p_partkey", n.alias("matches"), F.round(F.try_divide(n, F.size("g") + F.size("p") - n), 6).alias("soft_jaccard"))
