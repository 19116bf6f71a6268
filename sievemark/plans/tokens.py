"""Queries: token classes, elements, codons, contextual features and routing of the turns of conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import elements as E
from ..operators import retrieval as R  # noqa: F401
from ..operators.written import written
from .query import query

_LIST = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in words)
_Q = lambda pattern: "'" + pattern.replace("'", "''") + "'"
_THRESHOLD, _CUTOFF = 0.45, 0.35

_CLASS = f"""CASE WHEN lower(k) IN ({_LIST(E.CODE)}) THEN 'code_token' WHEN regexp_full_match(k, '[^\\p{{L}}\\p{{N}}_]+') THEN 'punctuation' WHEN lower(k) IN ({_LIST(E.NEGATION_MODAL)}) THEN 'negation'
    WHEN regexp_full_match(k, '\\[[0-9]+\\]|https?://\\S+') THEN 'citation' WHEN regexp_full_match(k, '[+-]?[0-9]+(\\.[0-9]+)?') THEN 'number' WHEN regexp_matches(k, {_Q(E.FORMULA)}) THEN 'formula'
    WHEN lower(k) IN ({_LIST(E.INSTRUCTION)}) THEN 'instruction' WHEN regexp_matches(k, '^\\p{{Lu}}') AND regexp_matches(k, '[A-Za-z]') THEN 'named_entity' WHEN lower(k) IN ({_LIST(E.CLASS_FUNCTION)}) THEN 'function_word'
    WHEN regexp_matches(k, '[A-Za-z]') THEN 'content_word' ELSE 'unknown' END"""
_BASE = f"regexp_replace(lower(k), {_Q(E.OUTER)}, '', 'g')"
_ELEMENT = (
    f"CASE WHEN lower(k) IN ({_LIST(E.CODE)}) THEN 'CODE' WHEN regexp_full_match(k, '[^\\p{{L}}\\p{{N}}_]+') THEN 'BOUNDARY' WHEN regexp_full_match(k, '\\[[0-9]+\\]|https?://\\S+') THEN 'CITATION' WHEN regexp_full_match(k, '(19|20)[0-9]{{2}}') THEN 'DATE' "
    f"WHEN regexp_full_match(k, '[+-]?[0-9]+(\\.[0-9]+)?') THEN 'NUMBER' WHEN {_BASE} IN ({_LIST(E.UNITS)}) THEN 'UNIT' WHEN regexp_matches(k, {_Q(E.FORMULA)}) THEN 'FORMULA' "
    + " ".join(f"WHEN {_BASE} IN ({_LIST(words.split())}) THEN '{label}'" for label, words in E.ELEMENT_WORDS.items())
    + f" WHEN regexp_matches(k, '^\\p{{Lu}}') AND regexp_matches(k, '[A-Za-z]') THEN 'ENTITY' WHEN regexp_matches({_BASE}, '(ing|ed|ate|ise|ize|ifies|ify)$') AND length({_BASE}) > 4 THEN 'ACTION' WHEN regexp_matches(k, '[A-Za-z]') THEN 'CONCEPT' ELSE 'UNKNOWN' END"
)
_WEIGHT = lambda weights, kind: f"CASE {kind} " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in weights.items()) + " END"
_NORM = r"CASE WHEN length({b}) > 3 AND suffix({b}, 's') AND NOT suffix({b}, 'ss') THEN left({b}, length({b}) - 1) ELSE {b} END".format(b=r"lower(regexp_replace(k, '^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$', '', 'g'))").replace("suffix(", "ends_with(")
_TOKENS = f"""t AS (SELECT conv_id, turn, text, regexp_extract_all(coalesce(text, ''), {_Q(E.LED_TOKENS)}) AS ks FROM conversations),
k AS (SELECT conv_id, turn, unnest(range(len(ks))) AS pos, starts_with(unnest(ks), chr(10)) AS led, ltrim(unnest(ks), chr(10)) AS k FROM t)"""
_IDF = """turns AS (SELECT count(*) AS n FROM conversations), df AS (SELECT lower(k) AS word, count(DISTINCT (conv_id, turn)) AS df FROM k GROUP BY 1),
idf AS (SELECT word, df, ln((1 + n) / (1 + df)::DOUBLE) + 1 AS idf FROM df, turns)"""


def _tokens(t) -> DataFrame:
    """conv_id, turn, pos, led (a newline stands before it), k of every token of every turn."""
    each = t.conversations.select("conv_id", "turn", F.posexplode(E.tokens(F.col("text"))).alias("pos", "led_k"))
    return each.select("conv_id", "turn", "pos", F.col("led_k").startswith("\n").alias("led"), F.ltrim(F.col("led_k"), F.lit("\n")).alias("k"))


_BARE = lambda x: F.ltrim(x, F.lit("\n"))


def _idf(t) -> DataFrame:
    """word and idf over all turns as documents, written once: the texts of a turn come together, so that its words are told apart in their row."""
    texts = t.conversations.groupBy("conv_id", "turn").agg(F.collect_list(F.coalesce("text", F.lit(""))).alias("texts"))
    words = F.array_distinct(F.flatten(F.transform("texts", lambda x: F.transform(E.tokens(x), lambda k: F.lower(_BARE(k))))))
    df = texts.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    n = t.conversations.agg(F.count("*").alias("n"))
    return written(df.crossJoin(F.broadcast(n)).select("word", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")))  # n: one row


#: Scores take the same part of every idf from here on (clamp((idf - 1) / 2) is 1). Below it are words of over an eighth of all turns: at most eight times as many as a turn's mean, whatever the table's size.
_RARE = 3.0


def _frequent(idf: DataFrame, word: str, value: str) -> DataFrame:
    return F.broadcast(idf.filter(F.col("idf") < _RARE).select(F.col("word").alias(word), F.col("idf").alias(value)))


@query(f"""
WITH {_TOKENS}, {_IDF}, c AS (SELECT conv_id, turn, pos, k, {_CLASS} AS class FROM k)
SELECT conv_id, turn, pos, k AS token, class, round(greatest(0, least(1, 0.65 * ({_WEIGHT(E.CLASS_WEIGHTS, 'class')}) + 0.35 * greatest(0, least(1, (idf - 1) / 2)))), 6) AS prior FROM c JOIN idf ON word = lower(k)""")
def token_priors(t):
    """Class and static score of every token."""
    k = _tokens(t)
    scored = k.withColumn("word", F.lower("k")).join(_frequent(_idf(t), "word", "idf"), "word", "left").withColumn("idf", F.coalesce("idf", F.lit(_RARE))).withColumn("class", E.token_class(F.col("k")))
    return scored.select("conv_id", "turn", "pos", F.col("k").alias("token"), "class", F.round(E.prior(F.col("class"), F.col("idf")), 6).alias("prior"))


def _of_turn(order: bool = True):
    w = Window.partitionBy("conv_id", "turn")
    return w.orderBy("pos") if order else w


_HAS = lambda group: "(" + " OR ".join(f"{x} IN ({_LIST(group)})" for x in "abc") + ")"
_ONLY = lambda group: "(" + " AND ".join(f"{x} IN ({_LIST(group)})" for x in "abc") + ")"
_CODON = f"""CASE WHEN {_HAS(['NEGATION', 'MODAL'])} AND NOT {_HAS(E.CONTENTFUL)} AND ({_HAS(E.WEAK)} OR {_ONLY([*E.WEAK, 'NEGATION', 'MODAL', 'PROBABILITY'])}) THEN 0.12 WHEN {_ONLY(E.WEAK)} THEN 0.05
    WHEN {_HAS(E.OPERATORS)} AND {_HAS(E.CONTENTFUL)} THEN greatest(CASE WHEN {_HAS(['RISK'])} THEN 0.88 ELSE 0 END, CASE WHEN {_HAS(['DEFINE'])} THEN 0.88 WHEN {_HAS(['THRESHOLD'])} AND {_HAS(['NUMBER', 'UNIT'])} THEN 0.90
        WHEN {_HAS(['NEGATION', 'MODAL'])} AND {_HAS(['ACTION', 'REQUIRE', 'RISK'])} THEN 0.92 ELSE 0.72 END)
    WHEN len(list_distinct(list_filter([a, b, c], lambda x: x IN ({_LIST(E.CONTENTFUL)})))) >= 2 THEN 0.66 WHEN {_HAS(E.CONTENTFUL)} THEN 0.5 ELSE 0.3 END"""
_ELEMENTS = f"""{_TOKENS}, e AS (SELECT conv_id, turn, pos, k, {_ELEMENT} AS element FROM k),
n AS (SELECT *, element AS a, lead(element, 1, 'BOUNDARY') OVER (PARTITION BY conv_id, turn ORDER BY pos) AS b, lead(element, 2, 'BOUNDARY') OVER (PARTITION BY conv_id, turn ORDER BY pos) AS c FROM e),
v AS (SELECT *, max({_CODON}) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS codon FROM n)"""


def _elements(t) -> DataFrame:
    """Tokens with their element and the value of the best codon that covers them."""
    e = _tokens(t).withColumn("element", E.element(F.col("k")))
    after = lambda n: F.lead("element", n, "BOUNDARY").over(_of_turn())
    valued = e.withColumn("b", after(1)).withColumn("c", after(2)).withColumn("value", E.codon_value(F.col("element"), F.col("b"), F.col("c")))
    return valued.withColumn("codon", F.max("value").over(_of_turn().rowsBetween(-2, 0)))


@query(f"WITH {_ELEMENTS} SELECT conv_id, turn, pos, k AS token, element, round({_WEIGHT(E.ELEMENT_WEIGHTS, 'element')}, 6) AS weight, round(codon, 6) AS codon FROM v")
def token_elements(t):
    """Functional element, its weight, and the best codon of every token."""
    return _elements(t).select("conv_id", "turn", "pos", F.col("k").alias("token"), "element", E.weight_of(F.col("element"), E.ELEMENT_WEIGHTS, 0.45).alias("weight"), "codon")


_ASKED = f"asked AS (SELECT DISTINCT conv_id, turn + 1 AS turn, {_NORM} AS norm FROM k WHERE regexp_matches(k, '[\\p{{L}}\\p{{N}}_]'))"
_BEFORE = "lag({c}) OVER (PARTITION BY conv_id, turn ORDER BY pos)"
_AFTER = "lead({c}) OVER (PARTITION BY conv_id, turn ORDER BY pos)"
_SIGN = lambda x, kind: f"coalesce({x} = '{kind}', false)"
_FEATURED = f"""{_TOKENS}, {_IDF}, {_ASKED}, most AS (SELECT max(idf) AS top, (SELECT idf FROM idf ORDER BY idf LIMIT 1 OFFSET (SELECT CAST(floor((count(*) - 1) * {_CUTOFF}) AS BIGINT) FROM idf)) AS cutoff FROM idf),
c AS (SELECT *, {_CLASS} AS class, {_NORM} AS norm, regexp_matches(k, '[\\p{{L}}\\p{{N}}_]') AS worded FROM k),
n AS (SELECT *, {_BEFORE.format(c='k')} AS l, {_AFTER.format(c='k')} AS r, {_BEFORE.format(c='class')} AS lc, {_AFTER.format(c='class')} AS rc, row_number() OVER (PARTITION BY conv_id, turn, norm ORDER BY pos) > 1 AS again,
    coalesce(sum(CASE WHEN k IN ('.', '!', '?') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence FROM c),
m AS (SELECT *, k NOT IN ('.', '!', '?') AND worded AND row_number() OVER (PARTITION BY conv_id, turn, sentence, worded ORDER BY pos) = 1 AS first FROM n),
j AS (SELECT m.*, asked.norm IS NOT NULL AS query_overlap, coalesce(i.idf, top) AS idf, coalesce(i.idf, top) <= cutoff AS low_idf, s.idf AS own_idf FROM m CROSS JOIN most LEFT JOIN asked ON asked.conv_id = m.conv_id AND asked.turn = m.turn AND asked.norm = m.norm LEFT JOIN idf i ON i.word = m.norm JOIN idf s ON s.word = lower(m.k)),
f AS (SELECT conv_id, turn, pos, k, class, query_overlap, class = 'named_entity' AS entity_flag, class = 'negation' OR {_SIGN('lc', 'negation')} OR {_SIGN('rc', 'negation')} AS negation_modal, l IS NULL OR coalesce(l IN ('.', '?', '!'), false) OR led OR first AS sentence_start,
    class = 'citation' OR {_SIGN('lc', 'citation')} OR {_SIGN('rc', 'citation')} AS citation_boundary, k IN ('"', '''') OR coalesce(l IN ('"', ''''), false) OR coalesce(r IN ('"', ''''), false) AS quote_boundary, low_idf AND again AS low_information,
    greatest(0, least(1, 0.65 * ({_WEIGHT(E.CLASS_WEIGHTS, 'class')}) + 0.35 * greatest(0, least(1, (own_idf - 1) / 2)))) AS static FROM j),
g AS (SELECT *, class IN ('named_entity', 'number', 'formula') AND low_information AND NOT query_overlap AND NOT (class IN ('citation', 'negation', 'code_token', 'instruction') OR negation_modal OR citation_boundary OR sentence_start OR quote_boundary) AS explicit_clear,
    greatest(0, least(1, static + {' + '.join(f'CASE WHEN {n} THEN {w} ELSE 0 END' for n, w in E.FEATURE_WEIGHTS.items())})) AS ctx FROM f),
s AS (SELECT *, greatest(0, least(1, 0.35 * static + 0.65 * ctx)) AS score FROM g),
a AS (SELECT *, CASE WHEN class IN ('negation', 'code_token', 'citation', 'instruction') THEN 'keep' WHEN class IN ('number', 'formula', 'named_entity') AND NOT explicit_clear THEN 'keep'
    WHEN class IN ('function_word', 'punctuation') AND (query_overlap OR negation_modal OR citation_boundary OR quote_boundary) THEN 'keep' WHEN round(score, 9) < {_THRESHOLD} THEN 'cheap' ELSE 'keep' END AS action FROM s)"""


#: So many parts hold the tokens of a turn together from its text to its summary; 200 million tokens make parts that are sorted in memory.
_PARTS = 256


def _met(t, low: DataFrame | None = None) -> DataFrame:
    """Every token with its norm, whether the turn before, as the question, has it, whether it stood in the turn before, and whether it is one of the turn's norms in low.

    Texts are shuffled, not tokens: a turn's tokens, the question's and low's lie in one row that is cut apart where all
    windows over the turn are.
    """
    turns = t.conversations.select("conv_id", "turn", "text")
    asked = turns.groupBy("conv_id", (F.col("turn") + 1).alias("turn")).agg(F.collect_list("text").alias("before"))
    if low is None:
        turns = turns.withColumn("low", F.array().cast("array<string>"))
    else:
        low = low.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), "low")
        turns = turns.join(low, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")), "left").drop("c", "t")
    rows = lambda kind, values: F.transform(values, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), x.alias("led_k")))
    question = F.array_distinct(F.flatten(F.transform(F.coalesce("before", F.array().cast("array<string>")), E.tokens)))
    every = F.concat(rows("own", E.tokens(F.col("text"))), rows("asked", question), rows("low", F.coalesce("low", F.array().cast("array<string>"))))
    each = turns.join(asked, ["conv_id", "turn"], "left").repartition(_PARTS, "conv_id", "turn").select("conv_id", "turn", F.explode(every).alias("x"))
    k = each.select("conv_id", "turn", "x.kind", "x.pos", F.col("x.led_k").startswith("\n").alias("led"), _BARE(F.col("x.led_k")).alias("k"))
    k = k.withColumn("worded", F.col("k").rlike(r"[\p{L}\p{N}_]")).filter((F.col("kind") != "asked") | F.col("worded")).withColumn("norm", F.when(F.col("kind") == "low", F.col("k")).otherwise(E.normalised(F.col("k"))))
    own = F.col("kind") == "own"
    # A norm's rows of the question and of low come first.
    w = Window.partitionBy("conv_id", "turn", "norm").orderBy(own, "pos").rowsBetween(Window.unboundedPreceding, 0)
    k = k.select("*", F.max(F.col("kind") == "asked").over(w).alias("query_overlap"), F.max(F.col("kind") == "low").over(w).alias("low"), (F.count_if(own).over(w) > 1).alias("again"))
    return k.filter(own).drop("kind")


def _low_norms(t, idf: DataFrame, cutoff: DataFrame) -> DataFrame:
    """conv_id, turn, low: norms that a turn repeats and that are rare words up to the cutoff."""
    norms = F.array_sort(F.transform(E.tokens(F.col("text")), lambda k: E.normalised(_BARE(k))))
    # Texts of one turn are put together, so that what each has once is repeated.
    texts = t.conversations.groupBy("conv_id", "turn").agg(F.array_join(F.collect_list("text"), " \n ").alias("text"))
    repeated = F.array_distinct(F.filter("norms", lambda x, i: x == F.get(F.col("norms"), i - 1)))
    each = texts.select("conv_id", "turn", norms.alias("norms")).select("conv_id", "turn", F.explode(repeated).alias("norm"))
    words = idf.crossJoin(F.broadcast(cutoff)).filter((F.col("idf") >= _RARE) & (F.col("idf") <= F.col("cutoff")) & (F.col("cutoff") < F.col("top")))  # one row
    rare = each.join(_frequent(idf, "norm", "known"), "norm", "left_anti")
    return rare.join(words.select(F.col("word").alias("norm")), "norm").groupBy("conv_id", "turn").agg(F.collect_list("norm").alias("low"))


def _cutoff(idf: DataFrame) -> DataFrame:
    """The highest idf and the one at the place floor((n - 1) * share) of the sorted ones: from the counts of each value, of which there are few."""
    counts = idf.groupBy("idf").agg(F.count("*").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy("idf"))).withColumn("all", F.sum("n").over(Window.partitionBy()))
    return upto.agg(F.max("idf").alias("top"), F.min(F.when(F.col("upto") > F.floor((F.col("all") - 1) * _CUTOFF), F.col("idf"))).alias("cutoff"))


def _featured(t) -> DataFrame:
    """Every token with its contextual features, scores and action; the turn before is the question."""
    idf = _idf(t)
    cutoff = _cutoff(idf)
    words = _met(t, _low_norms(t, idf, cutoff)).withColumn("class", E.token_class(F.col("k")))
    w, before = _of_turn(), _of_turn().rowsBetween(Window.unboundedPreceding, -1)
    near = lambda f, c: f(c).over(w)
    last = lambda c: F.max(F.when(c, F.col("pos"))).over(before)
    n = words.select("*", near(F.lag, "k").alias("l"), near(F.lead, "k").alias("r"), near(F.lag, "class").alias("lc"), near(F.lead, "class").alias("rc"), last(F.col("worded")).alias("word_at"), last(F.col("k").isin(".", "!", "?")).alias("stop_at"))
    # The first word behind the last sign that ends a sentence.
    n = n.withColumn("first", F.col("worded") & F.coalesce(F.col("word_at") < F.col("stop_at"), F.col("word_at").isNull()))
    n = n.join(_frequent(idf, "norm", "found"), "norm", "left").withColumn("word", F.lower("k")).join(_frequent(idf, "word", "own_idf"), "word", "left").withColumn("own_idf", F.coalesce("own_idf", F.lit(_RARE)))
    n = n.crossJoin(F.broadcast(cutoff))  # one row
    kind, some = F.col("class"), lambda c: F.coalesce(c, F.lit(False))
    beside = lambda x: (kind == x) | some(F.col("lc") == x) | some(F.col("rc") == x)
    quote = lambda c: some(F.col(c).isin('"', "'"))
    n = n.withColumn("low_information", F.coalesce(F.col("found") <= F.col("cutoff"), (F.col("top") <= F.col("cutoff")) | F.col("low")) & F.col("again"))
    n = n.select("*", (kind == "named_entity").alias("entity_flag"), beside("negation").alias("negation_modal"), beside("citation").alias("citation_boundary"), (F.col("l").isNull() | some(F.col("l").isin(".", "?", "!")) | F.col("led") | F.col("first")).alias("sentence_start"), (quote("k") | quote("l") | quote("r")).alias("quote_boundary"), E.prior(kind, F.col("own_idf")).alias("static"))
    guarded = kind.isin("citation", "negation", "code_token", "instruction") | F.col("negation_modal") | F.col("citation_boundary") | F.col("sentence_start") | F.col("quote_boundary")
    features: dict[str, Column] = {name: F.col(name) for name in E.FEATURE_WEIGHTS}
    n = n.withColumn("explicit_clear", kind.isin("named_entity", "number", "formula") & F.col("low_information") & ~F.col("query_overlap") & ~guarded)
    n = n.withColumn("score", E.clamp(0.35 * F.col("static") + 0.65 * E.contextual(F.col("static"), features)))
    return n.withColumn("action", E.token_action(kind, F.round("score", 9), _THRESHOLD, features | {"explicit_clear": F.col("explicit_clear")}))


@query(f"WITH {_FEATURED} SELECT conv_id, turn, pos, k AS token, {', '.join(E.FEATURE_WEIGHTS)}, explicit_clear, round(score, 6) AS score, action FROM a")
def contextual_routing(t):
    """Features, score and action of every token."""
    return _featured(t).select("conv_id", "turn", "pos", F.col("k").alias("token"), *E.FEATURE_WEIGHTS, "explicit_clear", F.round("score", 6).alias("score"), "action")


@query(f"""
WITH {_FEATURED} SELECT conv_id, turn, count(*) AS tokens, count(*) FILTER (WHERE action = 'keep') AS kept, count(*) FILTER (WHERE action = 'cheap') AS cheap, round(count(*) FILTER (WHERE action = 'cheap') / count(*)::DOUBLE, 6) AS reduction,
       count(*) FILTER (WHERE action = 'keep') > 0 AS recall_guard, coalesce(string_agg(k, ' ' ORDER BY pos) FILTER (WHERE action = 'keep'), '') AS kept_text,
       count(*) > 200 AND count(*) FILTER (WHERE action = 'keep') > 0 AND count(*) FILTER (WHERE action = 'cheap') / count(*)::DOUBLE >= 0.15 AS compressed FROM a GROUP BY 1, 2""")
def route_summaries(t):
    """What routing keeps of each turn; a turn counts as compressed from 200 tokens and a reduction of 0.15 on."""
    cheap = F.count_if(F.col("action") == "cheap")
    kept = F.array_sort(F.collect_list(F.when(F.col("action") == "keep", F.struct("pos", "k"))))
    s = _featured(t).groupBy("conv_id", "turn").agg(F.count("*").alias("tokens"), F.count_if(F.col("action") == "keep").alias("kept"), cheap.alias("cheap"), F.array_join(F.transform(kept, lambda x: x["k"]), " ").alias("kept_text"))
    reduction = F.col("cheap") / F.col("tokens")
    return s.select("*", F.round(reduction, 6).alias("reduction"), (F.col("kept") > 0).alias("recall_guard"), ((F.col("tokens") > 200) & (F.col("kept") > 0) & (reduction >= 0.15)).alias("compressed"))


@query(f"""
WITH {_ELEMENTS}, {_IDF}, {_ASKED}, most AS (SELECT max(idf) AS top FROM idf), j AS (SELECT v.*, asked.norm IS NOT NULL AS asked, coalesce(i.idf, top) AS idf FROM (SELECT *, {_NORM} AS norm FROM v) v CROSS JOIN most
    LEFT JOIN asked ON asked.conv_id = v.conv_id AND asked.turn = v.turn AND asked.norm = v.norm LEFT JOIN idf i ON i.word = v.norm),
s AS (SELECT *, greatest(0, least(1, 0.55 * ({_WEIGHT(E.ELEMENT_WEIGHTS, 'element')}) + 0.25 * greatest(0, least(1, (idf - 1) / 2)) + CASE WHEN asked THEN 0.30 ELSE 0 END)) AS score FROM j)
SELECT conv_id, turn, pos, k AS token, element, round(score, 6) AS score, CASE WHEN element IN ({_LIST(E.ALWAYS_KEPT)}) OR (element IN ({_LIST(E.KEPT_IF_ASKED)}) AND asked) THEN 'keep' WHEN round(score, 9) < {_THRESHOLD} THEN 'cheap' ELSE 'keep' END AS action FROM s""")
def element_routing(t):
    """The same by elements instead of classes."""
    idf = _idf(t)
    n = _met(t).withColumn("element", E.element(F.col("k"))).withColumn("asked", F.col("query_overlap")).join(_frequent(idf, "norm", "idf"), "norm", "left")
    n = n.crossJoin(F.broadcast(idf.agg(F.max("idf").alias("top"))))  # one row
    n = n.withColumn("score", E.element_score(F.col("element"), F.coalesce("idf", "top"), F.col("asked")))
    return n.select("conv_id", "turn", "pos", F.col("k").alias("token"), "element", F.round("score", 6).alias("score"), E.element_action(F.col("element"), F.round("score", 9), _THRESHOLD, F.col("asked")).alias("action"))


_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"


@query(f"""
WITH w AS (SELECT conv_id, turn, {_WORDS} AS ws, lag({_WORDS}) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations),
p AS (SELECT conv_id, turn, ws, CASE WHEN turn % 2 = 0 OR prev IS NULL THEN ws[2:5] WHEN turn % 3 = 0 THEN ws[2:4] || prev[1:1] ELSE prev[1:4] END AS phrase FROM w),
r AS (SELECT *, list_filter(range(0, len(ws) - len(phrase) + 1), lambda i: len(phrase) > 0 AND ws[i + 1:i + len(phrase)] = phrase) AS whole,
    list_filter(CASE WHEN len(phrase) = 4 THEN [phrase[1:3], phrase[2:4], phrase[1:2], phrase[2:3], phrase[3:4]] WHEN len(phrase) = 3 THEN [phrase[1:2], phrase[2:3]] ELSE [] END, lambda q: len(list_filter(range(0, len(ws) - len(q) + 1), lambda i: ws[i + 1:i + len(q)] = q)) > 0)[1] AS part FROM p),
h AS (SELECT conv_id, turn, len(phrase) AS wanted, CASE WHEN len(whole) > 0 THEN whole WHEN part IS NULL THEN [] ELSE list_filter(range(0, len(ws) - len(part) + 1), lambda i: ws[i + 1:i + len(part)] = part) END AS starts, CASE WHEN len(whole) > 0 THEN len(phrase) ELSE len(part) END AS width FROM r)
SELECT conv_id, turn, wanted, coalesce(list_sort(list_distinct(flatten(list_transform(starts, lambda s: range(s, s + width))))), []) AS places FROM h""")
def needed_phrases(t):
    """Where the tokens of a needed phrase stand in a turn: of the whole phrase, else of its longest part."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    w = t.conversations.select("conv_id", "turn", words.alias("ws")).withColumn("prev", F.lag("ws").over(Window.partitionBy("conv_id").orderBy("turn")))
    own, prev = F.slice("ws", 2, 4), F.slice("prev", 1, 4)
    phrase = F.when((F.col("turn") % 2 == 0) | F.col("prev").isNull(), own).when(F.col("turn") % 3 == 0, F.concat(F.slice("ws", 2, 3), F.slice("prev", 1, 1))).otherwise(prev)
    found = w.withColumn("phrase", phrase).select("conv_id", "turn", F.size("phrase").cast("long").alias("wanted"), E.needed_places(F.col("ws"), F.col("phrase")).alias("places"))
    return found.withColumn("places", F.transform(F.array_sort("places"), lambda x: x.cast("long")))
