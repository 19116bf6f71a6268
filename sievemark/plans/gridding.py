"""Queries: a training grid from one count, loss curves, drop orders, and rule tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import grids as G
from ..operators import rules as U
from .query import query
from .retrieving import _CLASS, _TOK, _WEIGHT

_TERMS = "list_transform(regexp_extract_all(d.text, '[A-Za-z0-9]+(?:''[A-Za-z]+)?'), lambda x: lower(x))"
_SETTINGS = [(s, i) for s, splits in (("one", (0,)), ("two", (0, 1)), ("four", (0, 1, 2, 3))) for i in splits]
_TESTS = [("near", 4), ("far", 5), ("both", 4), ("both", 5)]
_ROLES = [f"q{q}t{x}" for q in (0, 1) for x in (0, 1)]
_NAMES = [("fine", r, r) for r in _ROLES] + [("quality", r, r[:2]) for r in _ROLES] + [("toxic", r, r[2:]) for r in _ROLES]
_VALUES = lambda rows: ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


@query(f"""
WITH x AS (SELECT d.doc_id, d.doc_id % 6 AS split, 'q' || l.quality || 't' || l.toxic AS role, {_TERMS} AS ts FROM documents d JOIN labels l USING (doc_id)), st(setting, split) AS (VALUES {_VALUES(_SETTINGS)}), tst(test, split) AS (VALUES {_VALUES(_TESTS)}), tax(taxonomy, role, name) AS (VALUES {_VALUES(_NAMES)}),
e AS (SELECT doc_id, split, role, unnest(ts) AS term FROM x), c AS (SELECT setting, role, term, count(*) AS n FROM e JOIN st USING (split) GROUP BY 1, 2, 3), z AS (SELECT setting, role, sum(n) AS total FROM c GROUP BY 1, 2), v AS (SELECT setting, count(DISTINCT term) AS v FROM c GROUP BY 1),
p AS (SELECT setting, role, count(*) AS docs FROM x JOIN st USING (split) GROUP BY 1, 2), pt AS (SELECT setting, sum(docs) AS docs FROM p GROUP BY 1), tt AS (SELECT doc_id, test, term, count(*) AS k FROM e JOIN tst USING (split) GROUP BY 1, 2, 3),
s AS (SELECT tt.doc_id, tt.test, p.setting, p.role AS predicted, sum(tt.k * (ln(coalesce(c.n, 0) + 1) - ln(coalesce(z.total, 0) + v.v))) + max(ln(p.docs::DOUBLE / pt.docs)) AS score FROM tt CROSS JOIN p JOIN pt ON pt.setting = p.setting LEFT JOIN z ON z.setting = p.setting AND z.role = p.role JOIN v ON v.setting = p.setting LEFT JOIN c ON c.setting = p.setting AND c.role = p.role AND c.term = tt.term GROUP BY 1, 2, 3, 4),
r AS (SELECT s.*, x.role, row_number() OVER (PARTITION BY s.doc_id, test, setting ORDER BY round(score, 6) DESC, predicted) AS k FROM s JOIN x ON x.doc_id = s.doc_id), b AS (SELECT * FROM r WHERE k = 1)
SELECT setting, test, a.taxonomy || '_accuracy' AS metric, 'ALL' AS label, round(avg(CASE WHEN a.name = g.name THEN 1.0 ELSE 0.0 END), 6) AS value FROM b JOIN tax a ON a.role = b.role JOIN tax g ON g.role = b.predicted AND g.taxonomy = a.taxonomy GROUP BY 1, 2, 3
UNION ALL SELECT setting, test, 'per_role_f1', label, round(2 * count(*) FILTER (WHERE role = label AND predicted = label)::DOUBLE / (count(*) FILTER (WHERE role = label) + count(*) FILTER (WHERE predicted = label)), 6) FROM b, (SELECT unnest({_ROLES}) AS label) WHERE role = label OR predicted = label GROUP BY 1, 2, 4""")
def training_grid(t):
    """Three settings on three test sets under three taxonomies, and each role's F1: the texts are counted once."""
    frame = lambda rows, schema: t.spark.createDataFrame(rows, schema)
    role = F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string"))
    x = t.documents.select("doc_id", (F.col("doc_id") % 6).alias("split"), T.terms(F.col("text")).alias("ts")).join(t.labels.select("doc_id", role.alias("role")), "doc_id")
    found = G.grid_predictions(x, "doc_id", "split", "role", "ts", frame(_SETTINGS, "setting string, split long"), frame(_TESTS, "test string, split long"))
    return G.grid_metrics(found, frame(_NAMES, "taxonomy string, role string, name string")).withColumn("value", F.round("value", 6))


_SCORED = f"""k AS (SELECT conv_id, turn, i, ks[i] AS k FROM (SELECT *, unnest(range(1, len(ks) + 1)) AS i FROM (SELECT conv_id, turn, {_TOK.format(c='text')} AS ks FROM conversations))), c AS (SELECT *, {_CLASS} AS class, turn < max(turn) OVER (PARTITION BY conv_id, lower(k)) AS needed FROM k), s AS (SELECT *, {_WEIGHT} AS w FROM c)"""


def _scored(t):
    each = t.conversations.select("conv_id", "turn", F.posexplode(T.route_tokens(F.col("text"))).alias("i", "k"))
    later = F.col("turn") < F.max("turn").over(Window.partitionBy("conv_id", F.lower("k")))
    return each.select("conv_id", "turn", "i", "k", T.token_class(F.col("k")).alias("class"), later.alias("needed")).withColumn("w", T.class_weight(F.col("class")))


@query(f"""
WITH {_SCORED}, h AS (SELECT round(w, 6) AS threshold, count(*) AS n, count(*) FILTER (WHERE needed) AS m FROM s GROUP BY 1)
SELECT a.threshold, round(coalesce(sum(b.n), 0)::DOUBLE / (SELECT sum(n) FROM h), 6) AS token_reduction, round(1 - coalesce(sum(b.m), 0)::DOUBLE / (SELECT sum(m) FROM h), 6) AS recall FROM h a LEFT JOIN h b ON b.threshold < a.threshold GROUP BY 1""")
def token_loss_curve(t):
    """How many tokens each threshold saves, and how many that a later turn needs it loses."""
    s = _scored(t)
    return G.loss_curve(s, F.col("w"), F.col("needed")).select("threshold", F.round("token_reduction", 6).alias("token_reduction"), F.round("recall", 6).alias("recall"))


@query(f"""
WITH {_SCORED}, f AS (SELECT lower(k) AS term, count(DISTINCT conv_id) AS df FROM s GROUP BY 1), o AS (SELECT s.*, row_number() OVER (ORDER BY df DESC, CASE WHEN class IN ('function_word', 'punctuation') THEN 0 ELSE 1 END, conv_id, turn, i) AS place, count(*) OVER () AS n FROM s JOIN f ON f.term = lower(k)), d AS (SELECT *, place <= CAST(round_even(n * share, 0) AS BIGINT) AS dropped FROM o, (SELECT unnest([0.1, 0.33, 0.5]) AS share))
SELECT CAST(share AS DOUBLE) AS share, round(count(*) FILTER (WHERE dropped)::DOUBLE / count(*), 6) AS token_reduction, round(count(*) FILTER (WHERE needed AND NOT dropped)::DOUBLE / count(*) FILTER (WHERE needed), 6) AS recall FROM d GROUP BY 1""")
def naive_drop_baseline(t):
    """Tokens dropped from the most frequent on, function words and punctuation first among equals, up to three shares of all tokens."""
    s = _scored(t)
    df = s.groupBy(F.lower("k").alias("term")).agg(F.count_distinct("conv_id").alias("df"))
    rows = s.withColumn("term", F.lower("k")).join(df, "term").select((-F.col("df")).alias("rare"), F.when(F.col("class").isin("function_word", "punctuation"), 0).otherwise(1).alias("content"), F.struct("conv_id", "turn", "i").alias("place"), "needed")
    shares = [0.1, 0.33, 0.5]
    found = [(share, *(round(x, 6) for x in drop)) for share, drop in zip(shares, G.ordered_drops(rows, ["rare", "content"], "place", "needed", shares))]
    return t.spark.createDataFrame(found, "share double, token_reduction double, recall double")


#: A rule table of words that occur in the tables' texts.
RULES = [
    U.Rule("starts", "The ", "BACKGROUND"), U.Rule("contains", " der ", "DEFINE"), U.Rule("starts", "Le", "RESULT"), U.Rule("contains", " les ", "RESULT"), U.Rule("contains", "ation", "NEXT_STEP"), U.Rule("contains", " que ", "EXAMPLE"),
    U.Rule("contains", "@", "LIMITATION"), U.Rule("contains", " with ", "LIMITATION"), U.Rule("starts", "In", "METHOD"), U.Rule("contains", " of ", "METHOD"), U.Rule("contains", " o", "METHOD"),
]
_CASES = " ".join(f"WHEN {f'starts_with(s, {chr(39)}{r.pattern}{chr(39)})' if r.kind == 'starts' else f'contains(lower(s), {chr(39)}{r.pattern}{chr(39)})'} THEN '{r.role}'" for r in RULES)
_NEGATED = (" not ", " nicht ", " pas ")
_DENIES = "(" + " OR ".join(f"contains(lower(s), '{p}')" for p in _NEGATED) + ")"


@query(f"""
WITH x AS (SELECT doc_id, coalesce(text, '') AS s FROM documents), c AS (SELECT *, CASE {_CASES} ELSE 'CLAIM' END AS found FROM x), r AS (SELECT *, CASE WHEN found = 'NEXT_STEP' AND contains(lower(s), 'and') THEN 'LIMITATION' ELSE found END AS role FROM c)
SELECT doc_id, role, CASE WHEN role IN ('LIMITATION', 'CLAIM') AND {_DENIES} THEN 'NEGATED' WHEN role IN ('BACKGROUND', 'DEFINE', 'RESULT', 'EXAMPLE') THEN 'DESCRIPTIVE' WHEN role = 'LIMITATION' THEN 'LIMITED' ELSE 'ACTIVE' END AS operative_status,
       CASE role WHEN 'BACKGROUND' THEN 'sets_context' WHEN 'DEFINE' THEN 'defines' WHEN 'METHOD' THEN CASE WHEN contains(lower(s), 'map') THEN 'maps_to' WHEN contains(lower(s), 'require') OR contains(lower(s), 'obligation') THEN 'requires' ELSE 'recommends' END WHEN 'RESULT' THEN CASE WHEN contains(lower(s), 'retrieval') THEN 'supports_retrieval' ELSE 'reports_usefulness' END
         WHEN 'LIMITATION' THEN CASE WHEN {_DENIES} THEN 'limits' ELSE 'warns_about' END WHEN 'NEXT_STEP' THEN 'proposes_next_test' WHEN 'EXAMPLE' THEN 'gives_example' ELSE 'asserts' END AS relation,
       CASE WHEN role <> 'BACKGROUND' THEN 'YES' WHEN starts_with(s, 'The te') THEN 'NO' ELSE 'MAYBE' END AS answer_relevant FROM r""")
def ruled_documents(t):
    """Roles of documents by an ordered rule table with an exception, and what they let status, relation and relevance be."""
    x = t.documents.select("doc_id", F.coalesce("text", F.lit("")).alias("s"))
    ruled = x.select("doc_id", "s", U.role_of(F.col("s"), RULES, "CLAIM", {"NEXT_STEP": (("and",), "LIMITATION")}).alias("role"))
    return ruled.select("doc_id", "role", U.inferred(F.col("role"), F.col("s"), _NEGATED, F.col("s").startswith("The te")).alias("i")).select("doc_id", "role", "i.*")
