"""Queries: product quantiser, shortlists by its distances, inverted lists; every fiftieth vector is the stated query set."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..operators import quantiser as V
from ..operators import tables as J
from .query import query
from .retrieving import _COS, _NEAR, _exact

#: Parts and codes of the quantiser, lists and probes of the inverted file, and the shortlist: K * MULT keys a query.
PARTS, CODES, LISTS, PROBES, K, MULT = 32, 16, 16, 12, 10, 8
DIMS = 64

_FIXED = f"fx AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * {V.SCALE} + 0.5) AS BIGINT)) AS v FROM embeddings)"
_APART = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _kmeans(n: str, parts: int, codes: int) -> str:
    """The codebook {n}c (s, code, x) and the codes {n}a (vec_id, s, code) as SQL: one pair of steps a round."""
    width = DIMS // parts
    steps = [f"{n}b AS MATERIALIZED (SELECT vec_id, s, v[s * {width} + 1:s * {width} + {width}] AS x FROM fx, (SELECT unnest(range({parts})) AS s))", f"{n}c0 AS MATERIALIZED (SELECT * FROM (SELECT s, row_number() OVER (PARTITION BY s ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) - 1 AS code, x FROM {n}b) WHERE code < {codes})"]
    near = lambda c: f"SELECT b.vec_id, b.s, min(CAST({_APART.format(a='b.x', b='c.x')} AS BIGINT) * {codes} + c.code) % {codes} AS code, any_value(b.x) AS x FROM {n}b b JOIN {c} c ON b.s = c.s GROUP BY b.vec_id, b.s"
    means = "[" + ", ".join(f"CAST(floor(CAST(sum(x[{j + 1}]) AS DOUBLE) / count(*)) AS BIGINT)" for j in range(width)) + "]"
    for i in range(V.ROUNDS):
        steps += [f"{n}a{i} AS MATERIALIZED ({near(f'{n}c{i}')})", f"{n}c{i + 1} AS MATERIALIZED (SELECT c.s, c.code, coalesce(m.x, c.x) AS x FROM {n}c{i} c LEFT JOIN (SELECT s, code, {means} AS x FROM {n}a{i} GROUP BY s, code) m ON m.s = c.s AND m.code = c.code)"]
    return ", ".join([*steps, f"{n}a AS MATERIALIZED ({near(f'{n}c{V.ROUNDS}')})", f"{n}c AS (SELECT * FROM {n}c{V.ROUNDS})"])


_CODES = f"{_FIXED}, {_kmeans('p', PARTS, CODES)}, held AS MATERIALIZED (SELECT vec_id, string_agg(CAST(code AS VARCHAR), ' ' ORDER BY s) AS codes FROM pa GROUP BY vec_id)"
_FAR = f"""tb AS MATERIALIZED (SELECT b.vec_id AS q, b.s, c.code, CAST({_APART.format(a='b.x', b='c.x')} AS BIGINT) AS d FROM pb b JOIN pc c ON b.s = c.s WHERE b.vec_id % 50 = 0),
far AS (SELECT tb.q, a.vec_id, CAST(sum(d) AS BIGINT) AS d FROM tb JOIN pa a ON a.s = tb.s AND a.code = tb.code AND a.vec_id <> tb.q GROUP BY 1, 2)"""
_SHORT = "short AS (SELECT f.q, f.vec_id FROM (SELECT far.q, far.vec_id, row_number() OVER (PARTITION BY far.q ORDER BY CASE WHEN x.codes = y.codes THEN d ELSE 2 * d END, far.vec_id) AS place FROM far JOIN held x ON x.vec_id = far.q JOIN held y ON y.vec_id = far.vec_id{probed}) f WHERE place <= " + str(K * MULT) + ")"
_PROBED = f"""pr AS MATERIALIZED (SELECT q, code FROM (SELECT b.vec_id AS q, c.code, row_number() OVER (PARTITION BY b.vec_id ORDER BY CAST({_APART.format(a='b.x', b='c.x')} AS BIGINT), c.code) AS place FROM lb b JOIN lc c ON b.s = c.s WHERE b.vec_id % 50 = 0) WHERE place <= {PROBES})"""
_BY_LIST = " JOIN la ON la.vec_id = far.vec_id JOIN pr ON pr.q = far.q AND pr.code = la.code"
_VEC = "e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
_BEST = f"""s AS (SELECT c.q, c.vec_id, {_COS} AS score FROM short c JOIN e a ON a.vec_id = c.q JOIN e b ON b.vec_id = c.vec_id), best AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s)"""
_ALL = f"{_CODES}, {_FAR}, {_SHORT.format(probed='')}"
_LISTED = f"{_CODES}, {_kmeans('l', 1, LISTS)}, {_FAR}, {_PROBED}, {_SHORT.format(probed=_BY_LIST)}"
_RECALL = "SELECT r.q, round(count(short.vec_id) / 10.0, 6) AS recall, (SELECT count(*) FROM short z WHERE z.q = r.q) AS candidates FROM r LEFT JOIN short ON short.q = r.q AND short.vec_id = r.vec_id WHERE r.rank <= 10 GROUP BY r.q"


def _asked(t):
    return t.embeddings.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))


_train = partial(V.train, key="vec_id", vector="embedding")


def _books(t):
    return _train(t.embeddings, parts=PARTS, codes=CODES)


def _lists(t):
    return _train(t.embeddings, parts=1, codes=LISTS)


def _ranked(found):
    return J.ranked(found.withColumnRenamed("query", "q"), ["q"], F.desc(F.round("score", 9)), F.asc("vec_id")).select("q", "vec_id", F.round("score", 5).alias("score"), "rank")


def _recall(t, short):
    exact = _exact(t).select("q", "vec_id")
    found = short.select(F.col("query").alias("q"), "vec_id")
    sizes = found.groupBy("q").agg(F.count("*").alias("candidates"))
    hits = exact.join(found.withColumn("hit", F.lit(1)), ["q", "vec_id"], "left").groupBy("q").agg(F.round(F.count("hit") / F.lit(10.0), 6).alias("recall"))
    return hits.join(sizes, "q", "left").select("q", "recall", F.coalesce("candidates", F.lit(0).cast("long")).alias("candidates"))


@query(f"WITH {_CODES} SELECT vec_id, codes FROM held")
def product_codes(t):
    """The code of each of 32 parts of every vector, by codebooks trained on all of them."""
    return V.coded(t.embeddings, "vec_id", "embedding", _books(t)).select("vec_id", V.listed(F.col("codes")).alias("codes"))


@query(f"WITH {_VEC}, {_ALL}, {_BEST} SELECT q, vec_id, round(score, 5) AS score, rank FROM best WHERE rank <= 10")
def quantised_search(t):
    """A shortlist of 80 keys by the distances of codes, ranked by exact cosine."""
    return _ranked(V.quantised_search(t.embeddings, _asked(t), "vec_id", "embedding", _books(t), K, MULT))


@query(f"{_NEAR}, {_ALL} {_RECALL}")
def quantised_recall(t):
    """How many of the true ten nearest are in the shortlist, and its size."""
    everywhere = F.lit(0).cast("long").alias("group")
    books = _books(t)
    codes = V.coded(t.embeddings, "vec_id", "embedding", books).withColumn("group", everywhere)
    return _recall(t, V.shortlists(codes, _asked(t).withColumn("vector", F.col("vector").cast("array<double>")).withColumn("group", everywhere), "vec_id", books, K * MULT))


@query(f"WITH {_VEC}, {_LISTED}, {_BEST} SELECT q, vec_id, round(score, 5) AS score, rank FROM best WHERE rank <= 10")
def inverted_list_search(t):
    """As quantised_search over the codes of each query's nearest 12 of 16 inverted lists alone."""
    return _ranked(V.quantised_search(t.embeddings, _asked(t), "vec_id", "embedding", _books(t), K, MULT, _lists(t), PROBES))
