"""The queries of the training-data operators over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe_codec, divergence, exact_dedup, fingerprints, language_id, near_dedup, packing, pii, quality_classifier, quality_rules, resampling, secret_scan, token_counts
from .common import read_table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def op1_quality_classifier(spark, sf_dir):
    return quality_classifier.classify(_documents(spark, sf_dir))


def op2_packing(spark, sf_dir):
    return packing.pack(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op3_language_id(spark, sf_dir):
    return language_id.identify(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op4_quality_rules(spark, sf_dir):
    return quality_rules.judge(_documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


def op5_fingerprints(spark, sf_dir):
    return fingerprints.edited_likeness(_documents(spark, sf_dir))


def op6_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(_documents(spark, sf_dir))


def op7_byte_bpe(spark, sf_dir):
    return bpe_codec.digests(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op8_token_counts(spark, sf_dir):
    return token_counts.count_tokens(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op9_pii(spark, sf_dir):
    return pii.digests(_documents(spark, sf_dir))


def op10_secrets(spark, sf_dir):
    return secret_scan.digests(_documents(spark, sf_dir))


def op11_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(_documents(spark, sf_dir), digests=True)


def op12_source_divergence(spark, sf_dir):
    return divergence.divergence(_documents(spark, sf_dir))


def op13_importance_resampling(spark, sf_dir):
    return resampling.resample(_documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_quality_classifier, op2_packing, op3_language_id, op4_quality_rules, op5_fingerprints, op6_near_dedup, op7_byte_bpe, op8_token_counts, op9_pii, op10_secrets, op11_exact_dedup, op12_source_divergence, op13_importance_resampling, pipeline)
    return {f.__name__: f for f in ops}


#: Links on full shingle sets, and components by recursion. Words are those of the contract; A-Z are lower-cased.
OP6_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS s FROM w
), sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets),
items AS (SELECT doc_id, unnest(s) AS x FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes m ON m.doc_id = a JOIN sizes n ON n.doc_id = b WHERE 100 * c >= 75 * (m.n + n.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM sizes UNION SELECT reach.doc_id, e.b FROM reach JOIN edges e ON e.a = reach.r),
least AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sizes JOIN least USING (doc_id)
"""


_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Groups by whole texts.
OP11_SQL = f"""
WITH t AS (SELECT doc_id, {_FOLDED} AS folded FROM documents),
g AS (SELECT folded, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY folded)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(folded) AS text_sha256 FROM t JOIN g USING (folded)
"""

#: Every group against every kept term, the absent ones written out.
OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_FOLDED}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found FROM documents),
o AS (SELECT doc, lang, source, unnest(found) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o GROUP BY lang, source, term),
every AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT *, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS p FROM every),
l AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)) // (sum(sum(n)) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS q FROM every GROUP BY lang, term),
far AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(far.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source
    UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts) WHERE part = 'pair' OR rank <= 200
"""


def oracle_sql() -> dict[str, str]:
    """The queries that are SQL all through: the others tokenise, train, or hash as no SQL function does; tests hold them against brute force."""
    return {"op6_near_dedup": OP6_SQL, "op11_exact_dedup": OP11_SQL, "op12_source_divergence": OP12_SQL}
