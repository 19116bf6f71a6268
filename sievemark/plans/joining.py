"""Queries: joins, guards and keyed look-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tables as J
from .query import query


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'NO' ELSE 'YES' END AS pred_valid, coalesce(l.quality, -1) AS quality, CASE WHEN l.doc_id IS NULL THEN 'missing output' ELSE '' END AS pred_errors FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def left_join_missing_marker(t):
    joined = J.left_with_marker(t.documents.select("doc_id"), t.labels.select("doc_id", "quality"), "doc_id", "pred_valid")
    return joined.select("doc_id", "pred_valid", F.coalesce("quality", F.lit(-1)).alias("quality"), F.when(F.col("pred_valid") == "NO", "missing output").otherwise("").alias("pred_errors"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def missing_predictions(t):
    return t.customer.join(t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("SELECT DISTINCT c_custkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderpriority = '1-URGENT'")
def split_overlap(t):
    urgent = t.orders.filter(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey").join(urgent, "c_custkey", "left_semi")


@query("""
WITH e AS (SELECT DISTINCT doc_id FROM documents), g AS (SELECT DISTINCT doc_id FROM labels)
SELECT coalesce(e.doc_id, g.doc_id) AS doc_id, CASE WHEN e.doc_id IS NULL THEN 'unknown' WHEN g.doc_id IS NULL THEN 'missing' ELSE 'matched' END AS status FROM e FULL JOIN g ON e.doc_id = g.doc_id""")
def reconcile_all_outputs(t):
    """All documents reconciled with all labels."""
    return J.reconcile(t.documents, t.labels, "doc_id")


_RUNS = "SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts {d}, event_id {d}) AS k FROM events"


@query(f"SELECT user_id, event_id, event_type, value FROM ({_RUNS.format(d='')}) WHERE k = 1")
def first_record_per_key(t):
    return J.pick(t.events, "user_id", F.asc("ts"), F.asc("event_id")).select("user_id", "event_id", "event_type", "value")


@query(f"SELECT user_id, event_id, event_type, value FROM ({_RUNS.format(d='DESC')}) WHERE k = 1")
def last_record_per_key(t):
    return J.pick(t.events, "user_id", F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type", "value")


@query(f"""
WITH a AS (SELECT user_id, event_id FROM ({_RUNS.format(d='')}) WHERE k = 1 AND event_type <> 'click'), b AS (SELECT user_id, event_id FROM ({_RUNS.format(d='DESC')}) WHERE k = 1 AND event_type <> 'view')
SELECT coalesce(a.user_id, b.user_id) AS user_id, a.event_id AS first_event, b.event_id AS last_event FROM a FULL JOIN b ON a.user_id = b.user_id""")
def replay_record_and_run(t):
    a = first_record_per_key(t).filter("event_type <> 'click'").select("user_id", F.col("event_id").alias("first_event"))
    b = last_record_per_key(t).filter("event_type <> 'view'").select("user_id", F.col("event_id").alias("last_event"))
    return a.join(b, "user_id", "full")


@query(f"""
WITH r AS (SELECT user_id, event_id AS run_id, value AS run_value FROM ({_RUNS.format(d='DESC')}) WHERE k = 1)
SELECT e.event_id, e.user_id, e.event_type, r.run_id, r.run_value FROM events e JOIN r ON e.user_id = r.user_id WHERE e.value > 90 OR e.event_type = 'error'""")
def export_failures(t):
    """Audit rows (all of them) joined with the last run of their key, failures only."""
    runs = last_record_per_key(t).select("user_id", F.col("event_id").alias("run_id"), F.col("value").alias("run_value"))
    failed = t.events.filter((F.col("value") > 90) | (F.col("event_type") == "error"))
    return failed.join(runs, "user_id").select("event_id", "user_id", "event_type", "run_id", "run_value")


@query("""
SELECT o.o_orderkey, c.c_name, n.n_name, r.r_name, count(l.l_linenumber) AS lines, round(coalesce(sum(l.l_extendedprice), 0), 2) AS total
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey
GROUP BY 1, 2, 3, 4""")
def n_way_join(t):
    """The lines are summed by key before the join; the small sides broadcast by size."""
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("l_linenumber").alias("lines"), F.sum("l_extendedprice").alias("total"))
    named = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    joined = t.orders.join(named, F.col("o_custkey") == F.col("c_custkey")).join(lines, "o_orderkey", "left")
    return joined.select("o_orderkey", "c_name", "n_name", "r_name", F.coalesce("lines", F.lit(0).cast("long")).alias("lines"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"))


@query("""
WITH c AS (SELECT s.s_suppkey, p.p_partkey, p.p_size, p.p_size % 5 = s.s_suppkey % 5 AND p.p_retailprice > 1000 AS strict FROM supplier s JOIN part p ON s.s_nationkey = p.p_size % 25),
m AS (SELECT *, max(CASE WHEN strict THEN 1 ELSE 0 END) OVER (PARTITION BY s_suppkey) AS found FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY p_size DESC, p_partkey) AS k FROM m WHERE strict OR found = 0)
SELECT s_suppkey, p_partkey, p_size, strict FROM r WHERE k <= 3""")
def candidates_with_fallback(t):
    """A supplier's candidates hang on its nation and its key modulo 5 alone: three of each such group are kept before suppliers meet them, so that pairs aren't made."""
    strict = (F.col("p_size") % 5 == F.col("s_suppkey") % 5) & (F.col("p_retailprice") > 1000)
    parts = t.part.select("p_partkey", "p_size", "p_retailprice", (F.col("p_size") % 25).alias("s_nationkey"), (F.col("p_size") % 5).alias("fifth"))
    first = lambda df, *key: J.pick(df, list(key), F.desc("p_size"), F.asc("p_partkey"), n=3)
    suppliers = t.supplier.select("s_suppkey", "s_nationkey", (F.col("s_suppkey") % 5).alias("fifth"))
    fields = ["s_suppkey", "p_partkey", "p_size", strict.alias("strict")]
    met = suppliers.join(first(parts.filter("p_retailprice > 1000"), "s_nationkey", "fifth"), ["s_nationkey", "fifth"]).select(*fields)
    other = suppliers.join(first(parts.drop("fifth"), "s_nationkey"), "s_nationkey").select(*fields).filter(~F.coalesce("strict", F.lit(False)))
    return J.pick(J.with_fallback(met.unionByName(other), "s_suppkey", "strict"), "s_suppkey", F.desc("p_size"), F.asc("p_partkey"), n=3)


@query("""
WITH e AS (SELECT DISTINCT l_orderkey, l_suppkey % 40 AS s FROM lineitem)
SELECT a.s AS low, b.s AS high, count(*) AS segments, min(a.l_orderkey) AS first_segment FROM e a JOIN e b ON a.l_orderkey = b.l_orderkey AND a.s < b.s GROUP BY 1, 2""")
def entity_cooccurrence(t):
    """Pairs inside one segment (an order's few lines); the entities of a segment are distinct first."""
    e = t.lineitem.select("l_orderkey", (F.col("l_suppkey") % 40).alias("s")).distinct()
    pairs = e.withColumnRenamed("s", "low").join(e.withColumnRenamed("s", "high"), "l_orderkey").filter("low < high")
    return pairs.groupBy("low", "high").agg(F.count("*").alias("segments"), F.min("l_orderkey").alias("first_segment"))


@query("SELECT * FROM (SELECT 'orders' AS method, avg(o_totalprice) > 100000 AS high, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', avg(l_extendedprice) > 100000, count(*) FROM lineitem UNION ALL SELECT 'customer', avg(c_acctbal) > 100000, count(*) FROM customer)")
def union_of_results(t):
    part = lambda df, name, col: df.agg((F.avg(col) > 100000).alias("high"), F.count("*").alias("n")).select(F.lit(name).alias("method"), "high", "n")
    return part(t.orders, "orders", "o_totalprice").unionByName(part(t.lineitem, "lineitem", "l_extendedprice")).unionByName(part(t.customer, "customer", "c_acctbal"))


@query("SELECT doc_id, sha256(text) AS text_sha256, sha1(text) AS text_sha1, substr(sha256(concat(CAST(doc_id AS VARCHAR), '|', lang, '|', source)), 1, 16) || '-0' AS decision_id FROM documents")
def content_hashes(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.sha1("text").alias("text_sha1"), F.concat(F.substring(F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "lang", "source"), 256), 1, 16), F.lit("-0")).alias("decision_id"))
