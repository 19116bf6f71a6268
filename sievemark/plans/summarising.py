"""Queries: aggregates, ids, splits, set checks and segments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import linking as L
from ..operators import summaries as S
from ..operators import tables as J
from .query import query


@query("SELECT o_orderpriority, round(avg(o_orderkey), 4) AS o_orderkey, round(avg(o_custkey), 4) AS o_custkey, round(avg(o_totalprice), 4) AS o_totalprice FROM orders GROUP BY 1")
def numeric_means(t):
    m = S.numeric_means(t.orders, "o_orderpriority")
    return m.select("o_orderpriority", *(F.round(c, 4).alias(c) for c in m.columns if c != "o_orderpriority"))


@query("""SELECT event_type, list_sort(list(value))[CAST(round_even((count(value) - 1) * 0.5, 0) AS BIGINT) + 1] AS p50, list_sort(list(value))[CAST(round_even((count(value) - 1) * 0.95, 0) AS BIGINT) + 1] AS p95 FROM events GROUP BY 1""")
def nearest_rank_percentiles(t):
    """Exact places of sorted values, without a task that sorts a whole group."""
    return S.nearest_ranks(t.events, "event_type", "value", {"p50": 0.5, "p95": 0.95})


@query("SELECT event_type, round(median(value), 6) AS median FROM events GROUP BY 1")
def median_values(t):
    return t.events.groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("median"))


_BENCH = """SELECT l_returnflag, l_linenumber % 4 = 0 AS raw_correct, l_linenumber % 4 <> 2 AS catchable, CASE WHEN l_linenumber % 4 IN (1, 3) THEN 'RULED_OUT_WRONG' ELSE 'NOT_RULED_OUT' END AS verdict, CASE WHEN l_quantity > 40 THEN 'large' ELSE 'small' END AS size_class, l_extendedprice AS full_seconds, l_quantity AS route_seconds FROM lineitem"""


@query(f"""
SELECT l_returnflag, round(avg(CASE WHEN raw_correct THEN 1.0 ELSE 0 END), 6) AS raw_accuracy, round(count(*) FILTER (WHERE NOT raw_correct AND catchable AND verdict = 'RULED_OUT_WRONG') / count(*) FILTER (WHERE NOT raw_correct AND catchable), 6) AS catch_rate, round(count(*) FILTER (WHERE raw_correct AND verdict = 'RULED_OUT_WRONG') / count(*) FILTER (WHERE raw_correct), 6) AS false_rejection_rate,
       round(count(*) FILTER (WHERE NOT raw_correct AND catchable = (verdict = 'RULED_OUT_WRONG')) / count(*) FILTER (WHERE NOT raw_correct), 6) AS agreement, round(count(*) FILTER (WHERE NOT raw_correct AND NOT catchable AND verdict = 'RULED_OUT_WRONG') / count(*) FILTER (WHERE NOT raw_correct AND NOT catchable), 6) AS blind_spot_rate,
       round(sum(full_seconds) / sum(greatest(route_seconds, 1e-9)), 4) AS compute_saved, round(sum(full_seconds) FILTER (WHERE size_class = 'large') / sum(greatest(route_seconds, 1e-9)) FILTER (WHERE size_class = 'large'), 4) AS compute_saved_large FROM ({_BENCH}) GROUP BY 1""")
def bench_metrics(t):
    """Catch, false rejection, agreement, blind spots and time saved."""
    m = S.bench_metrics(t.lineitem.select(
        "l_returnflag", (F.col("l_linenumber") % 4 == 0).alias("raw_correct"), (F.col("l_linenumber") % 4 != 2).alias("catchable"), F.when((F.col("l_linenumber") % 4).isin(1, 3), "RULED_OUT_WRONG").otherwise("NOT_RULED_OUT").alias("verdict"),
        F.when(F.col("l_quantity") > 40, "large").otherwise("small").alias("size_class"), F.col("l_extendedprice").alias("full_seconds"), F.col("l_quantity").alias("route_seconds")), "l_returnflag")
    return m.select("l_returnflag", *(F.round(c, 4 if c.startswith("compute") else 6).alias(c) for c in m.columns if c != "l_returnflag"))


@query("SELECT o_orderkey, 'Q' || lpad(CAST(row_number() OVER (ORDER BY o_orderkey) AS VARCHAR), 8, '0') AS id FROM orders")
def sequential_order_ids(t):
    return S.sequential_ids(t.orders.select("o_orderkey"), F.floor(F.col("o_orderkey") / 500), F.asc("o_orderkey"), prefix="Q", width=8)


@query("""
WITH e AS (SELECT * FROM (VALUES ('1-URGENT', 300), ('2-HIGH', 0), ('6-NEVER', 4), ('5-LOW', 1)) v(p, expected)), c AS (SELECT o_orderpriority AS p, count(*) AS found FROM orders GROUP BY 1)
SELECT coalesce(c.p, e.p) AS o_orderpriority, coalesce(found, 0) AS found, CAST(coalesce(expected, 0) AS BIGINT) AS expected FROM c FULL JOIN e ON c.p = e.p WHERE coalesce(found, 0) <> coalesce(expected, 0)""")
def group_contract_breaks(t):
    expected = t.spark.createDataFrame([("1-URGENT", 300), ("2-HIGH", 0), ("6-NEVER", 4), ("5-LOW", 1)], "o_orderpriority string, expected long")
    return S.contract_breaks(t.orders, "o_orderpriority", expected)


_W = "regexp_extract_all(lower(text), '[a-z]+')"


@query(f"""
WITH w AS (SELECT conv_id, turn, role, {_W} AS ws, lag(lower(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations), x AS (SELECT role, unnest(ws) AS w, prev FROM w WHERE prev IS NOT NULL)
SELECT role, count(*) AS words, round(count(*) FILTER (WHERE contains(prev, w)) / count(*)::DOUBLE, 6) AS verbatim_rate, round(count(DISTINCT w) / count(*)::DOUBLE, 6) AS diversity FROM x GROUP BY 1""")
def verbatim_and_diversity(t):
    """How many words of a turn stand in the one before it, and how many are distinct."""
    w = t.conversations.select("role", "text", F.lag(F.lower("text")).over(Window.partitionBy("conv_id").orderBy("turn")).alias("prev")).filter("prev IS NOT NULL")
    x = w.select("role", "prev", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("w"))
    return x.groupBy("role").agg(F.count("*").alias("words"), F.round(F.count_if(F.contains("prev", "w")) / F.count("*"), 6).alias("verbatim_rate"), F.round(F.count_distinct("w") / F.count("*"), 6).alias("diversity"))


@query("""
WITH e AS (SELECT p_brand, list_distinct(string_split(lower(p_name), ' ')) AS gold, list_distinct(string_split(lower(p_type), ' ')) AS pred FROM part), x AS (SELECT p_brand, unnest(gold) AS g, pred FROM e)
SELECT p_brand, count(*) AS gold, count(*) FILTER (WHERE list_contains(pred, g)) AS exact, count(*) FILTER (WHERE NOT list_contains(pred, g) AND len(list_filter(pred, lambda p: contains(p, g) OR contains(g, p))) > 0) AS partly, count(*) FILTER (WHERE len(list_filter(pred, lambda p: contains(p, g) OR contains(g, p))) = 0) AS beyond FROM x GROUP BY 1""")
def entity_headroom(t):
    """How many gold items are found exactly, in part, or not at all."""
    e = t.part.select("p_brand", F.explode(F.array_distinct(F.split(F.lower("p_name"), " "))).alias("g"), F.split(F.lower("p_type"), " ").alias("pred"))
    exact, partly = F.array_contains("pred", F.col("g")), F.exists("pred", lambda p: F.contains(p, F.col("g")) | F.contains(F.col("g"), p))
    return e.groupBy("p_brand").agg(F.count("*").alias("gold"), F.count_if(exact).alias("exact"), F.count_if(~exact & partly).alias("partly"), F.count_if(~exact & ~partly).alias("beyond"))


@query("""
WITH e AS (SELECT doc_id, lang, list_distinct(regexp_extract_all(coalesce(text, ''), '[A-Z][a-z]{4,}')) AS es FROM documents WHERE lang IS NOT NULL), c AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS w FROM benchmark),
s AS (SELECT lang, count(*) AS n FROM (SELECT lang, unnest(es) AS w FROM e) WHERE w NOT IN (SELECT w FROM c) GROUP BY 1)
SELECT e.lang, count(*) AS n, round(avg(len(es)), 6) AS mean_entities, count(*) FILTER (WHERE len(es) = 0) AS empty, coalesce(max(s.n), 0) AS non_canonical FROM e LEFT JOIN s ON s.lang = e.lang GROUP BY 1""")
def entity_statistics(t):
    """Counts of entities and of those that the canonical list lacks."""
    d = t.documents.filter("lang IS NOT NULL").select("doc_id", "lang", F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([A-Z][a-z]{4,})"), F.lit(1))).alias("es"))
    canon = t.benchmark.select(F.explode(F.split("text", " ")).alias("w")).distinct()
    strange = d.select("lang", F.explode("es").alias("w")).join(canon, "w", "left_anti").groupBy("lang").agg(F.count("*").alias("non_canonical"))
    base = d.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(F.size("es")), 6).alias("mean_entities"), F.count_if(F.size("es") == 0).alias("empty"))
    return base.join(strange, "lang", "left").fillna(0, ["non_canonical"])


@query("""
WITH b AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS r FROM orders WHERE o_orderstatus = 'F')
SELECT c_custkey, o_orderkey, o_orderpriority, o_orderkey IS NOT NULL AS reviewed FROM customer LEFT JOIN b ON o_custkey = c_custkey AND r = 1""")
def best_and_left_over(t):
    """The most certain row of each key, and the keys that have none."""
    o = t.orders.filter("o_orderstatus = 'F'").withColumnRenamed("o_custkey", "c_custkey")
    return S.best_and_left(o, t.customer.select("c_custkey"), "c_custkey", F.asc("o_orderpriority"), F.desc("o_totalprice"), F.asc("o_orderkey")).select("c_custkey", "o_orderkey", "o_orderpriority", "reviewed")


@query("""
WITH u AS (SELECT l_orderkey, list_distinct(list(l_returnflag)) AS used FROM lineitem GROUP BY 1)
SELECT o_orderstatus, round(avg(CASE WHEN list_has_any(used, ['A', 'R']) THEN 1.0 ELSE 0 END), 6) AS source_hit, round(avg(CASE WHEN list_has_all(used, ['A', 'N']) THEN 1.0 ELSE 0 END), 6) AS all_sources FROM orders JOIN u ON l_orderkey = o_orderkey GROUP BY 1""")
def source_hits(t):
    """How often a required source is used, and how often all of them are."""
    u = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("used"))
    need = lambda *x: F.array(*map(F.lit, x))
    both = t.orders.join(u, F.col("l_orderkey") == F.col("o_orderkey"))
    return both.groupBy("o_orderstatus").agg(F.round(F.avg(F.arrays_overlap("used", need("A", "R")).cast("double")), 6).alias("source_hit"), F.round(F.avg(S.contains_all(need("A", "N"), F.col("used")).cast("double")), 6).alias("all_sources"))


@query("""
SELECT value, side FROM (SELECT DISTINCT p_brand AS value, 'missing' AS side FROM part WHERE p_size < 10 AND p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 40) UNION ALL SELECT DISTINCT p_brand, 'extra' FROM part WHERE p_size > 40 AND p_brand NOT IN (SELECT p_brand FROM part WHERE p_size < 10))""")
def enum_gaps(t):
    return S.enum_gaps(t.part.filter("p_size < 10"), t.part.filter("p_size > 40"), "p_brand")


@query("""
WITH a AS (SELECT l_partkey AS a, l_suppkey AS b, l_discount AS score, l_linenumber AS rank, ['disc'] AS sources FROM lineitem WHERE l_discount > 0.05 UNION ALL SELECT l_partkey, l_suppkey, l_tax, l_linenumber + 1, ['tax', 'all'] FROM lineitem WHERE l_tax > 0.04)
SELECT a, b, max(score) AS score, CAST(min(rank) AS INTEGER) AS rank, array_to_string(list_sort(list_distinct(flatten(list(sources)))), '+') AS sources FROM a GROUP BY 1, 2""")
def merged_candidate_pairs(t):
    one = lambda score, rank, where, *names: t.lineitem.filter(where).select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col(score).alias("score"), (F.col("l_linenumber") + rank).alias("rank"), F.array(*map(F.lit, names)).alias("sources"))
    return S.merged_pairs([one("l_discount", 0, "l_discount > 0.05", "disc"), one("l_tax", 1, "l_tax > 0.04", "tax", "all")]).withColumn("sources", F.array_join("sources", "+"))


@query("""
SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey WHERE l.l_orderkey = o.o_orderkey AND list_has_any(string_split(p_type, ' '), ['PROMO', 'LARGE']))""")
def overlap_semi_join(t):
    """Orders of parts that share a word with a set: the sets are exploded, so that the join is an equality."""
    words = t.part.select("p_partkey", F.explode(F.split("p_type", " ")).alias("w")).join(F.broadcast(t.spark.createDataFrame([("PROMO",), ("LARGE",)], "w string")), "w", "left_semi").select("p_partkey").distinct()
    keys = t.lineitem.join(words, F.col("l_partkey") == F.col("p_partkey"), "left_semi").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.join(keys, "o_orderkey", "left_semi").select("o_orderkey")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def uncached_tasks(t):
    """What a cache of results doesn't hold yet."""
    return t.documents.join(t.labels.select("doc_id"), "doc_id", "left_anti").select("doc_id", "source")


@query("""
WITH e AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0))
SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS place FROM e""")
def eligible_split(t):
    """What neither of two used sets holds, in hashed order; numbered in stretches of the hash."""
    rest = S.eligible(t.documents.select("doc_id"), [t.labels.filter("toxic = 1"), t.labels.filter("quality = 0")], "doc_id")
    return S.sequential_ids(rest, F.substring("order_hash", 1, 2), F.asc("order_hash"), F.asc("doc_id"), width=12, name="place").select("doc_id", F.col("place").cast("long").alias("place"))


@query("""
WITH m AS (SELECT 'low' AS model, avg(CASE WHEN (l_discount < 0.05) = (l_returnflag = 'R') THEN 1.0 ELSE 0 END) AS acc FROM lineitem UNION ALL SELECT 'high', avg(CASE WHEN (l_tax > 0.04) = (l_returnflag = 'R') THEN 1.0 ELSE 0 END) FROM lineitem), b AS (SELECT model FROM m ORDER BY acc DESC, model LIMIT 1)
SELECT l_orderkey, l_linenumber, (SELECT model FROM b) AS model, CASE WHEN (SELECT model FROM b) = 'low' THEN l_discount < 0.05 ELSE l_tax > 0.04 END AS pred FROM lineitem""")
def best_model_column(t):
    """The column of the model that scores best, chosen by one row of scores."""
    low, high, gold = F.col("l_discount") < 0.05, F.col("l_tax") > 0.04, F.col("l_returnflag") == "R"
    scores = t.lineitem.agg(F.avg((low == gold).cast("double")).alias("low"), F.avg((high == gold).cast("double")).alias("high"))
    best = scores.select(F.when(F.col("high") >= F.col("low"), "high").otherwise("low").alias("model"))
    return t.lineitem.crossJoin(F.broadcast(best)).select("l_orderkey", "l_linenumber", "model", F.when(F.col("model") == "low", low).otherwise(high).alias("pred"))  # best: one row


@query("""
WITH k AS (SELECT conv_id, turn, unnest(range(len(string_split(text, ' ')))) AS pos, unnest(string_split(text, ' ')) AS w FROM conversations), n AS (SELECT *, count(*) OVER (PARTITION BY conv_id, turn) AS n, row_number() OVER (PARTITION BY conv_id, turn ORDER BY md5('7:' || conv_id || ':' || turn || ':' || pos), pos) AS r FROM k)
SELECT conv_id, turn, string_agg(w, ' ' ORDER BY pos) FILTER (WHERE r > CAST(round_even(n * 0.3, 0) AS BIGINT)) AS kept FROM n GROUP BY 1, 2""")
def random_drop_baseline(t):
    """Three tenths of each turn's words dropped, by a hash that stands in for chance."""
    words = F.split("text", " ")
    hashed = F.transform(words, lambda w, i: F.struct(F.md5(F.concat_ws(":", F.lit("7"), F.col("conv_id").cast("string"), F.col("turn").cast("string"), i.cast("string"))).alias("h"), i.alias("pos"), w.alias("w")))
    kept = F.slice(F.array_sort(hashed), F.bround(F.size(words) * F.lit(0.3), 0).cast("int") + 1, F.size(words))
    in_order = F.array_sort(F.transform(kept, lambda x: F.struct(x["pos"].alias("pos"), x["w"].alias("w"))))
    return t.conversations.filter("text IS NOT NULL").select("conv_id", "turn", F.array_join(F.transform(in_order, lambda x: x["w"]), " ").alias("kept"))


@query("""
WITH s AS (SELECT role, conv_id, turn, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS r FROM conversations WHERE role IN ('user', 'assistant'))
SELECT role, conv_id, turn, CASE role WHEN 'assistant' THEN 0 ELSE 1 END AS place FROM s WHERE r <= 5""")
def role_samples_in_order(t):
    """Samples of each role put one after another in a fixed order of roles."""
    first = J.pick(t.conversations.filter(F.col("role").isin("user", "assistant")).select("role", "conv_id", "turn"), "role", F.asc("conv_id"), F.asc("turn"), n=5)
    return first.withColumn("place", F.array_position(F.array(F.lit("assistant"), F.lit("user")), F.col("role")).cast("int") - 1)


@query(r"""
WITH RECURSIVE p AS (SELECT conv_id, turn, unnest(range(len(ps))) AS part, unnest(ps) AS p FROM (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\n\s*\n+'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: length(x) >= 40) AS ps FROM conversations)),
s AS (SELECT conv_id, turn, part, CASE WHEN length(p) <= 200 THEN [p] ELSE string_split(regexp_replace(p, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) END AS xs, length(p) <= 200 AS whole FROM p),
f AS (SELECT conv_id, turn, part, xs, whole, 0 AS i, []::VARCHAR[] AS done, '' AS open FROM s UNION ALL SELECT conv_id, turn, part, xs, whole, i + 1, CASE WHEN length(open) + length(xs[i + 1]) < 200 OR length(open) <= 40 THEN done ELSE list_append(done, open) END, CASE WHEN length(open) + length(xs[i + 1]) < 200 THEN CASE WHEN open = '' THEN xs[i + 1] ELSE open || ' ' || xs[i + 1] END ELSE xs[i + 1] END FROM f WHERE i < len(xs)),
e AS (SELECT conv_id, turn, part, CASE WHEN whole THEN xs WHEN length(open) > 40 THEN list_append(done, open) ELSE done END AS segs FROM f WHERE i = len(xs))
SELECT conv_id, turn, array_to_string(flatten(list(segs ORDER BY part)), '|') AS segments FROM e GROUP BY 1, 2""")
def segmented_turns(t):
    """Turns in segments of whole sentences up to a budget."""
    s = t.conversations.select("conv_id", "turn", S.segments(F.col("text"), 200).alias("s"), F.size(F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"\n\s*\n+"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: F.length(p) >= 40)).alias("n"))
    return s.filter("n > 0").select("conv_id", "turn", F.array_join("s", "|").alias("segments"))


@query()
def matching_ratios(t):
    """Likeness of a part's name and type by matching blocks; no SQL function gives it, so tests hold it against the library's."""
    return t.part.select("p_partkey", F.round(S.matching_ratio(F.lower("p_name"), F.lower("p_type")), 6).alias("ratio"))


@query("SELECT count(*) AS n, count(*) * 256 AS raw, count(*) * 32 AS bits, count(*) * 64 AS bands, count(*) * 8 + 16 * 256 AS codes FROM embeddings")
def index_footprints(t):
    sizes = t.embeddings.agg(F.count("*").alias("n"))
    return sizes.select("n", *(c.alias(k) for k, c in S.index_bytes(F.col("n"), 64, 256, bands=8, subspaces=8, centroids=16).items()))


@query("""
WITH d AS (SELECT p_partkey, ' ' || regexp_replace(lower(p_type || ' ' || p_name), '[^a-z0-9]+', ' ', 'g') || ' ' AS s FROM part), n AS (SELECT p_partkey, list_distinct(list_filter([CASE WHEN contains(s, ' ring ') THEN 'jewel' END, CASE WHEN contains(s, ' new ring ') THEN 'new jewel' END, CASE WHEN contains(s, ' large ') THEN 'large' END, CASE WHEN contains(s, ' promo ') THEN 'offer' END], lambda x: x IS NOT NULL)) AS ns FROM d),
i AS (SELECT p_partkey, list_distinct(ns || CASE WHEN list_contains(ns, 'large') THEN ['jewel'] ELSE [] END) AS ns FROM n)
SELECT p_partkey, unnest(list_filter(ns, lambda x: NOT (x = 'jewel' AND list_contains(ns, 'new jewel')))) AS name FROM i""")
def ontology_names(t):
    """Names of a lexicon, with those that come along and without those that a longer one covers."""
    lexicon = t.spark.createDataFrame([("ring", "jewel"), ("new ring", "new jewel"), ("large", "large"), ("promo", "offer")], "phrase string, name string")
    pair = lambda a, b, c: t.spark.createDataFrame([(a, b)], f"name string, {c} string")
    texts = t.part.select("p_partkey", F.concat_ws(" ", "p_type", "p_name").alias("text"))
    return L.named(texts, "p_partkey", "text", lexicon, pair("large", "jewel", "also"), pair("jewel", "new jewel", "by"))


@query(r"""
WITH x AS (SELECT item_id, text || CASE item_id % 3 WHEN 0 THEN ' said "one two" and New York City' ELSE '' END AS s FROM benchmark), u AS (SELECT item_id, s, regexp_extract_all(s, '"([^"\n]{2,60})"', 1) || regexp_extract_all(s, '[A-Z][a-z]+(?: [A-Z][a-z]+)+') AS us, regexp_extract_all(lower(s), '[a-z]{6,}') AS ws FROM x),
d AS (SELECT item_id, list_filter(us, lambda y, i: list_position(us, y) = i) AS us, ws FROM u)
SELECT item_id, array_to_string(CASE WHEN len(us) >= 2 THEN us[1:8] ELSE list_transform(list_sort(list_transform(list_distinct(ws), lambda w: {'n': -len(list_filter(ws, lambda y: y = w)), 'i': list_position(ws, w), 'w': w})), lambda r: r.w)[1:8] END, '|') AS spans FROM d""")
def salient_spans(t):
    """Quoted and proper spans; where there are fewer than two, frequent long words."""
    s = F.concat(F.col("text"), F.when(F.col("item_id") % 3 == 0, ' said "one two" and New York City').otherwise(""))
    return t.benchmark.select("item_id", F.array_join(S.spans(s), "|").alias("spans"))
