"""Queries: predictions against labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation as E
from ..operators import summaries as S
from ..operators import tables as J
from .query import query

_PRED = "CASE WHEN text LIKE '%!!%' OR text LIKE '% | %' OR text LIKE '%***%' THEN 0 ELSE 1 END"
_LABELLED = f"SELECT d.doc_id, d.lang, d.source, d.n_chars, d.text, l.quality AS gold, {_PRED} AS pred FROM documents d JOIN labels l ON d.doc_id = l.doc_id"


def _labelled(t):
    docs = t.documents.withColumn("pred", F.expr(_PRED))
    return docs.join(t.labels.select("doc_id", F.col("quality").alias("gold")), "doc_id")


@query(f"SELECT gold, pred, count(*) AS n FROM ({_LABELLED}) GROUP BY 1, 2")
def label_confusion(t):
    return E.confusion(_labelled(t), "gold", "pred")


@query(f"""
WITH x AS ({_LABELLED}), labels2 AS (SELECT gold AS label FROM x UNION SELECT pred FROM x), c AS (SELECT gold, pred, count(*) AS n FROM x GROUP BY 1, 2)
SELECT g.label AS gold, p.label AS pred, coalesce(c.n, 0) AS n FROM labels2 g CROSS JOIN labels2 p LEFT JOIN c ON c.gold = g.label AND c.pred = p.label""")
def label_confusion_dense(t):
    return E.dense_confusion(_labelled(t), "gold", "pred")


_PRF = """
WITH x AS ({source}), s AS (
    SELECT {by} gold AS label, 1 AS support, 0 AS predicted, CASE WHEN gold = pred THEN 1 ELSE 0 END AS tp FROM x
    UNION ALL SELECT {by} pred, 0, 1, 0 FROM x
), a AS (SELECT {by} label, CAST(sum(support) AS BIGINT) AS support, sum(predicted) AS predicted, sum(tp) AS tp FROM s GROUP BY {by} label),
r AS (SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE tp::DOUBLE / predicted END AS p, CASE WHEN support = 0 THEN 0 ELSE tp::DOUBLE / support END AS q FROM a)
SELECT {by} label, support, round(p, 6) AS precision, round(q, 6) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 6) AS f1 FROM r"""


@query(_PRF.format(source=_LABELLED, by=""))
def label_scores(t):
    return E.prf(_labelled(t), "gold", "pred")


@query(_PRF.format(source=_LABELLED, by="lang,"))
def label_scores_by_language(t):
    return E.prf(_labelled(t), "gold", "pred", ("lang",))


_ROLES = {"en": "west", "de": "west", "fr": "romance", "es": "romance"}
_ROLE_SQL = "CASE {c} WHEN 'en' THEN 'west' WHEN 'de' THEN 'west' ELSE 'romance' END"
_GUESS = "CASE WHEN text LIKE '% the %' THEN 'en' WHEN text LIKE '% der %' THEN 'de' WHEN text LIKE '% la %' THEN 'fr' ELSE 'es' END"


@query(_PRF.format(by="taxonomy,", source=f"SELECT 'fine' AS taxonomy, lang AS gold, {_GUESS} AS pred FROM documents UNION ALL SELECT 'coarse', {_ROLE_SQL.format(c='lang')}, {_ROLE_SQL.format(c='(' + _GUESS + ')')} FROM documents"))
def taxonomy_scores(t):
    """One evaluation for every taxonomy: each row counts once under the fine and once under the mapped labels."""
    roles = F.create_map(*(F.lit(x) for pair in _ROLES.items() for x in pair))
    guessed = t.documents.select(F.col("lang").alias("gold"), F.expr(_GUESS).alias("pred"))
    both = guessed.select(F.explode(F.array(F.struct(F.lit("fine").alias("taxonomy"), "gold", "pred"), F.struct(F.lit("coarse").alias("taxonomy"), F.element_at(roles, F.col("gold")).alias("gold"), F.element_at(roles, F.col("pred")).alias("pred")))).alias("s")).select("s.*")
    return E.prf(both, "gold", "pred", ("taxonomy",))


@query(f"SELECT lang, count(*) AS n, round(avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy, bool_and(gold = pred) AS all_right, bool_or(gold = pred) AS any_right FROM ({_LABELLED}) GROUP BY 1")
def accuracy_by_language(t):
    hit = F.col("gold") == F.col("pred")
    return _labelled(t).groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(hit.cast("double")), 6).alias("accuracy"), F.bool_and(hit).alias("all_right"), F.bool_or(hit).alias("any_right"))


@query(f"SELECT least(gold, pred) AS low, greatest(gold, pred) AS high, count(*) AS n, count(*) FILTER (WHERE gold < pred) AS upward FROM ({_LABELLED}) WHERE gold <> pred GROUP BY 1, 2")
def unordered_error_pairs(t):
    wrong = _labelled(t).filter("gold <> pred")
    return wrong.groupBy(F.least("gold", "pred").alias("low"), F.greatest("gold", "pred").alias("high")).agg(F.count("*").alias("n"), F.count_if(F.col("gold") < F.col("pred")).alias("upward"))


_SETS = "SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS g, list_distinct(string_split(lower(p_type), ' ')) AS p FROM part"


@query(f"""
WITH s AS ({_SETS}), m AS (SELECT p_partkey, len(list_intersect(g, p)) AS h, len(g) AS ng, len(p) AS np FROM s)
SELECT p_partkey, h = ng AND h = np AS exact, round(h::DOUBLE / np, 6) AS precision, round(h::DOUBLE / ng, 6) AS recall,
       round(CASE WHEN h > 0 THEN 2.0 * h / (ng + np) ELSE 0 END, 6) AS f1, round(h::DOUBLE / (ng + np - h), 6) AS jaccard FROM m""")
def entity_set_scores(t):
    cells = t.part.select("p_partkey", T.entities(F.replace("p_name", F.lit(" "), F.lit("|"))).alias("g"), T.entities(F.replace("p_type", F.lit(" "), F.lit("|"))).alias("p"))
    scores = E.set_scores(F.col("g"), F.col("p"))
    return cells.select("p_partkey", "g", "p", scores["exact"].alias("exact"), *(F.round(scores[k], 6).alias(k) for k in ("precision", "recall", "f1", "jaccard"))).drop("g", "p")


@query("""
SELECT 'o_orderstatus' AS dimension, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2
UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2
UNION ALL SELECT 'year', CAST(year(o_orderdate) AS VARCHAR), count(*) FROM orders GROUP BY 2""")
def value_counts_by_dimension(t):
    return E.value_counts(t.orders.withColumn("year", F.year("o_orderdate")), ["o_orderstatus", "o_orderpriority", "year"])


@query("""
WITH x AS (SELECT coalesce(g, 'all') AS model, value FROM (SELECT event_type AS g, value FROM events UNION ALL SELECT NULL, value FROM events))
SELECT model, count(*) AS n, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) AS high_rate,
       list_sort(list(value))[CAST(round_even((count(*) - 1) * 0.5, 0) AS BIGINT) + 1] AS p50, list_sort(list(value))[CAST(round_even((count(*) - 1) * 0.95, 0) AS BIGINT) + 1] AS p95
FROM x GROUP BY 1""")
def audit_summary(t):
    """Overall and by model: counts by a rollup, nearest-rank percentiles without a task that sorts a whole group."""
    counts = t.events.rollup("event_type").agg(F.count("*").alias("n"), F.round(F.avg((F.col("value") > 50).cast("double")), 6).alias("high_rate")).select(F.coalesce("event_type", F.lit("all")).alias("model"), "n", "high_rate")
    both = t.events.select(F.explode(F.array(F.col("event_type"), F.lit("all"))).alias("model"), "value")
    return counts.join(S.nearest_ranks(both, "model", "value", {"p50": 0.5, "p95": 0.95}), "model")


_VARIANTS = "(SELECT c_custkey, (CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) + (CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END) AS a, (CASE WHEN c_acctbal > 4000 THEN 1 ELSE 0 END) + (CASE WHEN c_nationkey % 2 = 0 THEN 1 ELSE 0 END) AS b FROM customer)"


@query(f"SELECT CASE WHEN a > b THEN 'loss' WHEN a < b THEN 'win' ELSE 'tie' END AS outcome, count(*) AS n FROM {_VARIANTS} GROUP BY 1")
def win_loss_tie(t):
    flag = lambda c: c.cast("int")
    a = flag(F.col("c_acctbal") > 0) + flag(F.col("c_mktsegment") == "BUILDING")
    b = flag(F.col("c_acctbal") > 4000) + flag(F.col("c_nationkey") % 2 == 0)
    return t.customer.groupBy(F.when(a > b, "loss").when(a < b, "win").otherwise("tie").alias("outcome")).agg(F.count("*").alias("n"))


_CHECKS = ["role", "status", "answer", "entities"]


@query("""
WITH c AS (SELECT l_orderkey, l_linenumber, l_returnflag <> 'R' AS role, l_linestatus = 'O' AS status, l_discount < 0.08 AS answer, l_quantity >= 25 AS entities FROM lineitem),
f AS (SELECT role AND status AND answer AND entities AS strict, role AND answer AS relaxed_role_only, role AND answer AND entities AS relaxed_full,
       array_to_string(list_filter([CASE WHEN NOT role THEN 'role' END, CASE WHEN NOT status THEN 'status' END, CASE WHEN NOT answer THEN 'answer' END, CASE WHEN NOT entities THEN 'entities' END], lambda x: x IS NOT NULL), '+') AS pattern FROM c)
SELECT CASE WHEN pattern = '' THEN 'none' ELSE pattern END AS pattern, count(*) AS n, count(*) FILTER (WHERE strict) AS strict, count(*) FILTER (WHERE relaxed_role_only) AS relaxed_role_only, count(*) FILTER (WHERE relaxed_full) AS relaxed_full FROM f GROUP BY 1""")
def full_row_failures(t):
    """Strict and relaxed row scores (both definitions of relaxed) by the pattern of failed fields."""
    c = t.lineitem.select((F.col("l_returnflag") != "R").alias("role"), (F.col("l_linestatus") == "O").alias("status"), (F.col("l_discount") < 0.08).alias("answer"), (F.col("l_quantity") >= 25).alias("entities"))
    pattern = F.array_join(F.array_compact(F.array(*(F.when(~F.col(k), k) for k in _CHECKS))), "+")
    every = F.col("role") & F.col("status") & F.col("answer") & F.col("entities")
    return c.groupBy(F.when(pattern == "", "none").otherwise(pattern).alias("pattern")).agg(F.count("*").alias("n"), F.count_if(every).alias("strict"), F.count_if(F.col("role") & F.col("answer")).alias("relaxed_role_only"), F.count_if(F.col("role") & F.col("answer") & F.col("entities")).alias("relaxed_full"))


@query("""
WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS k, sum(n) OVER (PARTITION BY source) AS total FROM c)
SELECT source, round(sum(n) FILTER (WHERE k <= 2)::DOUBLE / max(total), 6) AS top2_share, sum(n) FILTER (WHERE k <= 2)::DOUBLE / max(total) >= 0.8 AS collapsed FROM r GROUP BY 1""")
def role_collapse(t):
    counts = t.documents.groupBy("source", "lang").agg(F.count("*").alias("n"))
    share = F.sum(F.when(F.col("rank") <= 2, F.col("n"))) / F.sum("n")
    return J.ranked(counts, ["source"], F.desc("n"), F.asc("lang")).groupBy("source").agg(F.round(share, 6).alias("top2_share"), (share >= 0.8).alias("collapsed"))


@query("""
SELECT 'text' AS column_name, count(*) FILTER (WHERE coalesce(trim(text), '') = '') AS empty FROM documents
UNION ALL SELECT 'lang', count(*) FILTER (WHERE coalesce(trim(lang), '') = '') FROM documents
UNION ALL SELECT 'source', count(*) FILTER (WHERE coalesce(trim(source), '') = '') FROM documents""")
def empty_value_counts(t):
    cols = ["text", "lang", "source"]
    counts = t.documents.agg(*(F.count_if(F.coalesce(F.trim(c), F.lit("")) == "").alias(c) for c in cols))
    return counts.unpivot([], cols, "column_name", "empty")


@query("SELECT md5(text) AS text_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_texts(t):
    return t.documents.groupBy(F.md5("text").alias("text_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


_SWEEP = "SELECT th.threshold, d.gold, CASE WHEN d.n_chars >= th.threshold * 100 THEN 1 ELSE 0 END AS pred FROM x d CROSS JOIN (SELECT unnest(range(1, 20)) * 5 AS threshold) th"


@query(f"""
WITH x AS ({_LABELLED}), s AS ({_SWEEP})
SELECT threshold, count(*) FILTER (WHERE pred = 1) AS kept, round(count(*) FILTER (WHERE pred = 1 AND gold = 1)::DOUBLE / greatest(count(*) FILTER (WHERE gold = 1), 1), 6) AS recall, round(count(*) FILTER (WHERE pred = 0)::DOUBLE / count(*), 6) AS reduction FROM s GROUP BY 1""")
def threshold_sweep(t):
    """All thresholds in one pass over the rows."""
    swept = _labelled(t).select("gold", "n_chars", F.explode(F.array(*(F.lit(5 * i).cast("long") for i in range(1, 20)))).alias("threshold"))
    kept, good = F.col("n_chars") >= F.col("threshold") * 100, F.col("gold") == 1
    return swept.groupBy("threshold").agg(F.count_if(kept).alias("kept"), F.round(F.count_if(kept & good) / F.greatest(F.count_if(good), F.lit(1)), 6).alias("recall"), F.round(F.count_if(~kept) / F.count("*"), 6).alias("reduction"))


@query(f"""
WITH x AS ({_LABELLED}), s AS ({_SWEEP}), m AS (SELECT threshold, count(*) FILTER (WHERE pred = 1 AND gold = 1)::DOUBLE / greatest(count(*) FILTER (WHERE gold = 1), 1) AS recall, count(*) FILTER (WHERE pred = 0)::DOUBLE / count(*) AS reduction FROM s GROUP BY 1),
tiers AS (SELECT unnest([0.01, 0.05, 0.1, 0.2]::DOUBLE[]) AS tier), r AS (SELECT tier, threshold, recall, reduction, row_number() OVER (PARTITION BY tier ORDER BY reduction DESC, threshold) AS k FROM tiers JOIN m ON 1 - recall < tier)
SELECT tier, threshold, round(recall, 6) AS recall, round(reduction, 6) AS reduction FROM r WHERE k = 1""")
def frontier_by_tier(t):
    """The largest reduction within each allowed loss of recall."""
    swept = threshold_sweep_exact(t)
    tiers = swept.select("*", F.explode(F.array(*map(F.lit, (0.01, 0.05, 0.1, 0.2)))).alias("tier")).filter(1 - F.col("recall") < F.col("tier"))
    return J.pick(tiers, "tier", F.desc("reduction"), F.asc("threshold")).select("tier", "threshold", F.round("recall", 6).alias("recall"), F.round("reduction", 6).alias("reduction"))


def threshold_sweep_exact(t):
    swept = _labelled(t).select("gold", "n_chars", F.explode(F.array(*(F.lit(5 * i).cast("long") for i in range(1, 20)))).alias("threshold"))
    kept, good = F.col("n_chars") >= F.col("threshold") * 100, F.col("gold") == 1
    return swept.groupBy("threshold").agg((F.count_if(kept & good) / F.greatest(F.count_if(good), F.lit(1))).alias("recall"), (F.count_if(~kept) / F.count("*")).alias("reduction"))


@query("""
WITH m AS (SELECT o_custkey % 50 AS config, avg(CASE WHEN o_totalprice > 150000 THEN 1.0 ELSE 0.0 END) AS p, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS r, count(*) AS n FROM orders GROUP BY 1),
f AS (SELECT *, bool_or(p >= 0.55) OVER () AS above FROM m), k AS (SELECT * FROM f WHERE p >= 0.55 OR NOT above), h AS (SELECT config, p, r, n, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS hm FROM k)
SELECT config, n, round(p, 6) AS p, round(r, 6) AS r, round(hm, 6) AS harmonic FROM h ORDER BY round(hm, 9) DESC, round(p, 9) DESC, n DESC, config LIMIT 1""")
def select_config(t):
    """Best configuration above a floor of precision (all of them where none is), by harmonic mean and further keys."""
    hit = lambda c: F.avg(c.cast("double"))
    m = t.orders.groupBy((F.col("o_custkey") % 50).alias("config")).agg(hit(F.col("o_totalprice") > 150000).alias("p"), hit(F.col("o_orderstatus") == "F").alias("r"), F.count("*").alias("n"))
    some = m.agg(F.bool_or(F.col("p") >= 0.55).alias("some"))
    k = m.crossJoin(F.broadcast(some)).filter((F.col("p") >= 0.55) | ~F.col("some"))
    h = k.withColumn("hm", F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0)))
    return h.orderBy(F.desc(F.round("hm", 9)), F.desc(F.round("p", 9)), F.desc("n"), "config").limit(1).select("config", "n", F.round("p", 6).alias("p"), F.round("r", 6).alias("r"), F.round("hm", 6).alias("harmonic"))
