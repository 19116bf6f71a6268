"""Queries: the centroid classifier and cross-validated Naive Bayes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bayes, centroids
from .query import query

_TERMS = "list_transform(regexp_extract_all(d.text, '[A-Za-z0-9]+(?:''[A-Za-z]+)?'), lambda x: lower(x))"
_ROWS = f"x AS (SELECT d.doc_id, l.quality AS role, {_TERMS} AS ts FROM documents d JOIN labels l USING (doc_id))"


def _labelled(t):
    return t.documents.select("doc_id", T.terms(F.col("text")).alias("ts")).join(t.labels.select("doc_id", F.col("quality").alias("role")), "doc_id")


_FOLDS = f"""WITH {_ROWS}, f AS (SELECT unnest(range(5)) AS fold), e AS (SELECT doc_id, doc_id % 5 AS own, role, unnest(ts) AS term FROM x),
c AS (SELECT fold, role, term, count(*) AS n FROM e JOIN f ON own <> fold GROUP BY 1, 2, 3), z AS (SELECT fold, role, sum(n) AS total FROM c GROUP BY 1, 2), v AS (SELECT fold, count(DISTINCT term) AS v FROM c GROUP BY 1),
p AS (SELECT fold, role, count(*) AS docs FROM x JOIN f ON doc_id % 5 <> fold GROUP BY 1, 2), pt AS (SELECT fold, sum(docs) AS docs FROM p GROUP BY 1), tt AS (SELECT doc_id, own AS fold, term, count(*) AS k FROM e GROUP BY 1, 2, 3),
s AS (SELECT tt.doc_id, tt.fold, p.role, sum(tt.k * (ln(coalesce(c.n, 0) + 1) - ln(z.total + v.v))) + max(ln(p.docs::DOUBLE / pt.docs)) AS score
 FROM tt JOIN p ON p.fold = tt.fold JOIN pt ON pt.fold = tt.fold JOIN z ON z.fold = tt.fold AND z.role = p.role JOIN v ON v.fold = tt.fold LEFT JOIN c ON c.fold = tt.fold AND c.role = p.role AND c.term = tt.term GROUP BY 1, 2, 3),"""


@query(f"""
{_FOLDS}
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, role) AS k FROM s)
SELECT doc_id, fold, role AS predicted FROM r WHERE k = 1""")
def naive_bayes_folds(t):
    """Every document predicted by the model of the other four folds, in one job: training counts are totals less the fold's."""
    x = _labelled(t).withColumn("fold", F.col("doc_id") % 5)
    return bayes.cross_validated(x, "doc_id", "role", "ts", "fold").select("doc_id", "fold", F.col("role").alias("predicted"))


@query(f"""
{_FOLDS}
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, role) AS k, lead(score) OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, role) AS second FROM s)
SELECT doc_id, role AS predicted, round(score - second, 3) AS margin FROM r WHERE k = 1""")
def naive_bayes_fold_margins(t):
    """Multinomial Naive Bayes and its margin over the second label, of every document by the model of the other four folds."""
    x = _labelled(t).withColumn("fold", F.col("doc_id") % 5)
    return bayes.cross_validated(x, "doc_id", "role", "ts", "fold").select("doc_id", F.col("role").alias("predicted"), F.round("margin", 3).alias("margin"))


@query(f"""
WITH {_ROWS}, f AS (SELECT unnest(range(5)) AS fold), e AS (SELECT doc_id, role, len(ts) AS n, unnest(ts) AS term FROM x), c AS (SELECT doc_id, doc_id % 5 AS own, role, term, count(*)::DOUBLE / max(n) AS tf FROM e GROUP BY 1, 2, 3, 4),
z AS (SELECT fold, count(*) AS n FROM x JOIN f ON doc_id % 5 <> fold GROUP BY 1), i AS (SELECT z.fold, term, ln((1 + max(z.n)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM c JOIN z ON own <> z.fold GROUP BY 1, 2),
w AS (SELECT f.fold, doc_id, own, role, c.term, tf * coalesce(idf, 1.0) AS w FROM c CROSS JOIN f LEFT JOIN i ON i.fold = f.fold AND i.term = c.term), m AS (SELECT fold, doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1, 2), v AS (SELECT fold, doc_id, own, role, term, w / norm AS w FROM w JOIN m USING (fold, doc_id)),
g AS (SELECT fold, role, term, sum(w) AS w FROM v WHERE own <> fold GROUP BY 1, 2, 3), h AS (SELECT fold, role, sqrt(sum(w * w)) AS norm FROM g GROUP BY 1, 2),
s AS (SELECT v.doc_id, g.role, sum(v.w * g.w) / max(h.norm) AS score FROM v JOIN g ON g.fold = v.fold AND g.term = v.term JOIN h ON h.fold = g.fold AND h.role = g.role WHERE v.own = v.fold GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, role) AS k FROM s)
SELECT doc_id, role AS predicted, round(score, 6) AS score FROM r WHERE k = 1""")
def centroid_fold_predictions(t):
    """As centroid_predictions, of every document by the model of the other four folds."""
    x = _labelled(t).withColumn("fold", F.col("doc_id") % 5)
    return centroids.cross_validated(x, "doc_id", "role", "ts", "fold", 5).select("doc_id", F.col("role").alias("predicted"), F.round("score", 6).alias("score"))
