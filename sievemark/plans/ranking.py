"""Queries: windows over token rows, ranking, splits and budgets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import tables as J
from .query import query

_TURNS = "SELECT conv_id, turn, role, length(text) AS n FROM conversations"


@query(f"""
WITH x AS ({_TURNS})
SELECT conv_id, turn, coalesce(lag(role) OVER w, '') AS before, coalesce(lead(role) OVER w, '') AS after, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS seen, CAST(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running
FROM x WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def neighbours_and_running(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    n = F.length("text")
    return t.conversations.select("conv_id", "turn", F.lag("role", 1, "").over(w).alias("before"), F.lead("role", 1, "").over(w).alias("after"), (F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn")) - 1).cast("long").alias("seen"), F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long").alias("running"))


_SPACED = "list_filter(string_split(item.text, ' '), lambda x: x <> '')"


@query(f"""
WITH i AS (SELECT item_id, {_SPACED} AS ws FROM benchmark item), tok AS (SELECT item_id, unnest(range(len(ws))) AS pos, unnest(ws) AS token FROM i),
e AS (SELECT *, lag(token) OVER (PARTITION BY item_id ORDER BY pos) AS prev FROM tok), s AS (SELECT *, CASE WHEN prev IS NULL OR right(prev, 1) IN ('.', '?', '!') THEN 1 ELSE 0 END AS initial FROM e),
q AS (SELECT *, sum(initial) OVER (PARTITION BY item_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS sentence FROM s)
SELECT item_id, CAST(sentence AS BIGINT) AS sentence, count(*) AS tokens, min_by(token, pos) AS first_token FROM q GROUP BY 1, 2""")
def sentences_of_tokens(t):
    tok = t.benchmark.select("item_id", F.posexplode(F.filter(F.split("text", " "), lambda x: x != "")).alias("pos", "token"))
    w = Window.partitionBy("item_id").orderBy("pos")
    prev = F.lag("token").over(w)
    marked = tok.withColumn("initial", (prev.isNull() | F.right(prev, F.lit(1)).isin(".", "?", "!")).cast("int"))
    return marked.withColumn("sentence", F.sum("initial").over(w).cast("long")).groupBy("item_id", "sentence").agg(F.count("*").alias("tokens"), F.min_by("token", "pos").alias("first_token"))


@query(f"""
WITH i AS (SELECT item_id, {_SPACED} AS ws FROM benchmark item), tok AS (SELECT item_id, unnest(range(len(ws))) AS pos, length(unnest(ws)) AS v FROM i),
c AS (SELECT item_id, pos, v + coalesce(lead(v, 1) OVER w, 0) + coalesce(lead(v, 2) OVER w, 0) AS codon FROM tok WINDOW w AS (PARTITION BY item_id ORDER BY pos))
SELECT item_id, pos, CAST(max(codon) OVER (PARTITION BY item_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS best FROM c""")
def best_covering_trigram(t):
    tok = t.benchmark.select("item_id", F.posexplode(F.filter(F.split("text", " "), lambda x: x != "")).alias("pos", "token"))
    w = Window.partitionBy("item_id").orderBy("pos")
    v = F.length("token")
    codon = tok.withColumn("codon", v + F.coalesce(F.lead(v, 1).over(w), F.lit(0)) + F.coalesce(F.lead(v, 2).over(w), F.lit(0)))
    return codon.select("item_id", F.col("pos").cast("long").alias("pos"), F.max("codon").over(w.rowsBetween(-2, 0)).cast("long").alias("best"))


@query("SELECT l_orderkey, l_linenumber, rank FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank FROM lineitem) WHERE rank <= 2")
def top_n_per_group(t):
    return J.ranked(t.lineitem, ["l_orderkey"], F.desc("l_extendedprice"), F.asc("l_linenumber")).filter("rank <= 2").select("l_orderkey", "l_linenumber", "rank")


@query("""
WITH x AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT doc_id, lang, CASE WHEN i * 100 < n * 70 THEN 'train' WHEN i * 100 < n * 85 THEN 'dev' ELSE 'test' END AS split FROM x""")
def stratified_split(t):
    """Shares of each language in the order of a hash of the id."""
    h = F.md5(F.col("doc_id").cast("string"))
    return J.split_by_position(t.documents.select("doc_id", "lang"), "lang", F.substring(h, 1, 2), h, F.col("doc_id"))


@query("SELECT doc_id, lang, fold FROM (SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1) % 5 AS fold FROM documents)")
def round_robin_folds(t):
    h = F.md5(F.col("doc_id").cast("string"))
    return J.placed(t.documents.select("doc_id", "lang"), "lang", F.substring(h, 1, 2), h, F.col("doc_id")).select("doc_id", "lang", (F.col("place") % 5).alias("fold"))


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR) || '7'), doc_id) AS k FROM documents) WHERE k <= 20")
def balanced_sample(t):
    """A sampling operator: twenty of each class in hash order."""
    return J.pick(t.documents.select("doc_id", "lang"), "lang", F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("7"))), F.asc("doc_id"), n=20)


@query("""
WITH x AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n, max(value) OVER (PARTITION BY user_id) AS top FROM events),
s AS (SELECT *, 0.5 * value / greatest(top, 1e-9) + 0.2 * exp(-0.1 * (n - 1 - pos)) + 0.3 * (event_id % 3) / 2.0 AS importance FROM x), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(importance, 9) DESC, pos) AS k FROM s)
SELECT user_id, event_id, round(importance, 6) AS importance, pos < 1 OR k <= 5 AS kept FROM r""")
def budgeted_keep_set(t):
    """Position importance (mass, recency, prior) and the kept places: the first, and the most important within the budget."""
    own = Window.partitionBy("user_id")
    placed = t.events.select("user_id", "event_id", "value", (F.row_number().over(own.orderBy("ts", "event_id")) - 1).alias("pos"), F.count("*").over(own).alias("n"), F.max("value").over(own).alias("top"))
    importance = 0.5 * F.col("value") / F.greatest("top", F.lit(1e-9)) + 0.2 * F.exp(-0.1 * (F.col("n") - 1 - F.col("pos"))) + 0.3 * (F.col("event_id") % 3) / 2.0
    scored = placed.withColumn("importance", importance)
    rank = F.row_number().over(own.orderBy(F.desc(F.round("importance", 9)), "pos"))
    return scored.withColumn("k", rank).select("user_id", "event_id", F.round("importance", 6).alias("importance"), ((F.col("pos") < 1) | (F.col("k") <= 5)).alias("kept"))


@query("""
SELECT p_brand, max_by(p_name, struct_pack(a := p_retailprice, b := p_size, c := -p_partkey)) AS best_name, max(p_retailprice) AS best_price, count(*) AS n FROM part GROUP BY 1""")
def best_per_group(t):
    return t.part.groupBy("p_brand").agg(F.max_by("p_name", F.struct("p_retailprice", "p_size", -F.col("p_partkey"))).alias("best_name"), F.max("p_retailprice").alias("best_price"), F.count("*").alias("n"))


@query("""
WITH o AS (SELECT o_orderkey, o_custkey, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END AS p, o_totalprice FROM orders)
SELECT o_orderkey, p AS priority, row_number() OVER (PARTITION BY o_custkey ORDER BY p, o_totalprice DESC, o_orderkey) AS rank FROM o""")
def review_order(t):
    p = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    return J.ranked(t.orders.withColumn("priority", p), ["o_custkey"], F.asc("priority"), F.desc("o_totalprice"), F.asc("o_orderkey")).select("o_orderkey", "priority", "rank")


@query("SELECT event_id, ts, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 25")
def tail_newest_first(t):
    return t.events.orderBy(F.desc("ts"), F.desc("event_id")).limit(25).select("event_id", "ts", "value")


@query(r"""
WITH x AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM documents)
SELECT doc_id, CASE WHEN length(flat) > 60 THEN substr(flat, 1, 57) || '...' ELSE flat END AS preview FROM x""")
def clipped_previews(t):
    return t.documents.select("doc_id", T.clip(F.col("text"), 60).alias("preview"))
