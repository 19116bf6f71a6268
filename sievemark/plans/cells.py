"""Queries: cells of several items, predicates and derived cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import predicates as P
from .query import query

_CELL = """CASE p_partkey % 9 WHEN 0 THEN replace(p_name, ' ', '|') || '||nan| A ' WHEN 1 THEN replace(p_type, ' ', '; ') || ';b; b' WHEN 2 THEN '["x", "' || p_brand || '", "x", ""]' WHEN 3 THEN ''
    WHEN 4 THEN replace(p_name, ' ', ', ') WHEN 5 THEN NULL WHEN 6 THEN 'one' || chr(10) || p_brand WHEN 7 THEN '[not json]' ELSE '  ' || p_name || ' ' END"""
_SYNONYMS = {"large": "big", "small": "little", "b": "bee"}
_T = "coalesce(cell, '')"
_CUT = lambda sep, inner="x": f"list_filter(list_transform({sep}, lambda x: trim({inner})), lambda x: x <> '')"
_JSON = f"CASE WHEN regexp_full_match(trim({_T}), '\\[.*\\]', 's') AND json_valid(trim({_T})) THEN list_filter(list_transform(CAST(trim({_T}) AS JSON)->>'$[*]', lambda x: trim(coalesce(x, ''))), lambda x: x <> '') END"
_SET = lambda x: f"array_to_string(list_sort(list_distinct({x})), '+')"
_FIRST = lambda x: f"array_to_string(list_transform(list_filter(range(1, len({x}) + 1), lambda i: list_position({x}, ({x})[i]) = i), lambda i: ({x})[i]), '+')"


@query(f"""
WITH c AS (SELECT p_partkey, {_CELL} AS cell FROM part), j AS (SELECT *, {_JSON} AS js, {_CUT(f"string_split({_T}, ';')")} AS parts FROM c)
SELECT p_partkey, {_SET(_CUT(f"string_split({_T}, '|')", 'lower(x)'))} AS piped_lower, {_SET(f"list_filter(string_split({_T}, '|'), lambda x: x <> '' AND lower(x) <> 'nan')")} AS piped_as_written, {_SET("list_transform(parts, lambda x: lower(x))")} AS semicolon_lower,
       {_SET("list_transform(parts, lambda x: " + f"CASE lower(x) {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in _SYNONYMS.items())} ELSE lower(x) END)")} AS canonical, array_to_string(coalesce(js, CASE WHEN contains({_T}, ';') THEN parts ELSE {_CUT(f"string_split({_T}, ',')")} END), '+') AS list_or_separated,
       array_to_string(CASE WHEN trim({_T}) = '' THEN [] WHEN js IS NOT NULL THEN js WHEN contains({_T}, ';') THEN parts WHEN contains({_T}, '|') THEN {_CUT(f"string_split({_T}, '|')")} WHEN contains({_T}, chr(10)) THEN {_CUT(f"string_split({_T}, chr(10))")} ELSE [trim({_T})] END, '+') AS items,
       CASE WHEN trim({_T}) = '' THEN 'empty' WHEN js IS NOT NULL THEN 'json_list' WHEN contains({_T}, ';') THEN 'semicolon' WHEN contains({_T}, '|') THEN 'pipe' WHEN contains({_T}, chr(10)) THEN 'newline' ELSE 'single' END AS format,
       array_to_string({_CUT(f"regexp_split_to_array({_T}, '[|;]')")}, '+') AS phrases, {_FIRST("coalesce(js, parts)")} AS ordered FROM j""")
def entity_cells(t):
    """Eight contracts for cells of several items, on the same cells."""
    cell, joined, as_set = F.col("cell"), lambda x: F.array_join(x, "+"), lambda x: F.array_join(F.array_sort(x), "+")
    c = t.part.select("p_partkey", F.expr(_CELL).alias("cell"))
    return c.select(
        "p_partkey", as_set(C.piped_lower(cell)).alias("piped_lower"), as_set(C.piped_as_written(cell)).alias("piped_as_written"), as_set(C.semicolon_lower(cell)).alias("semicolon_lower"), as_set(C.semicolon_canonical(cell, _SYNONYMS)).alias("canonical"),
        joined(C.list_or_separated(cell)).alias("list_or_separated"), joined(C.with_format(cell)["items"]).alias("items"), C.with_format(cell)["format"].alias("format"), joined(C.phrases(cell)).alias("phrases"), joined(C.ordered_distinct(cell)).alias("ordered"),
    )


_WORDS = "list_filter(string_split(regexp_replace(lower(p_name || ' Boxes'' ties'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"


@query(f"""
SELECT p_partkey, array_to_string(list_transform({_WORDS}, lambda w: CASE WHEN length(w) > 3 AND ends_with(w, 's') THEN left(w, length(w) - 1) ELSE w END), ' ') AS normal,
       CASE WHEN p_size % 3 = 0 THEN regexp_replace(lower(p_type), '$', 'y') WHEN p_size % 3 = 1 THEN lower(p_type) ELSE lower(p_type) || 'ss' END AS singular,
       array_to_string(list_filter(['steel', 'brass', 'tin'], lambda x: contains(lower(p_type), x)) || list_sort(list_filter(list_distinct(string_split(lower(p_type), ' ')), lambda x: x NOT IN ('steel', 'brass', 'tin'))), '+') AS ordered,
       round(CASE WHEN p_size % 5 = 0 THEN 1.0 ELSE 0.5 END, 6) AS jaccard_one, round(CASE WHEN p_size % 5 = 0 THEN 0.0 ELSE 0.5 END, 6) AS jaccard_zero FROM part""")
def normal_names(t):
    """Names to compare by, a canonical order, and the two contracts for Jaccard of empty sets."""
    ending = F.when(F.col("p_size") % 3 == 0, "ies").when(F.col("p_size") % 3 == 1, "s").otherwise("ss")
    a = F.when(F.col("p_size") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"), F.lit("b")))
    b = F.when(F.col("p_size") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a")))
    return t.part.select(
        "p_partkey", C.normal_name(F.concat("p_name", F.lit(" Boxes' ties"))).alias("normal"), C.singular_name(F.concat("p_type", ending)).alias("singular"),
        F.array_join(C.in_order(F.array_distinct(F.split(F.lower("p_type"), " ")), ["steel", "brass", "tin"]), "+").alias("ordered"), C.jaccard(a, b, 1.0).alias("jaccard_one"), C.jaccard(a, b, 0.0).alias("jaccard_zero"),
    )


_FLAG = "CASE turn % 4 WHEN 0 THEN ' yes' WHEN 1 THEN '' WHEN 2 THEN 'NO' END"
_OUT = """CASE turn % 5 WHEN 0 THEN '{"error": "x"}' WHEN 1 THEN '{"answer": 1}' WHEN 2 THEN 'the host: Connection Refused' WHEN 3 THEN 'Title: ' || text ELSE '### RULE: ' || text END"""
_REC = """CASE turn % 3 WHEN 0 THEN '{"known_wrong": true}' WHEN 1 THEN '{"known_wrong": false}' ELSE 'none' END"""
_STATUS = "CASE turn % 2 WHEN 0 THEN 'accepted' ELSE 'rejected' END"


@query(f"""
WITH x AS (SELECT conv_id, turn, role, text, {_FLAG} AS flag, {_OUT} AS output, {_REC} AS rec, {_STATUS} AS status FROM conversations)
SELECT conv_id, turn, upper(trim(coalesce(flag, ''))) = 'YES' AS included, upper(trim(coalesce(flag, ''))) IN ('YES', '') AS included_blank, coalesce(role NOT IN ('user', 'assistant'), true) AS outside, contains(lower(text), 'the ') OR contains(lower(text), ' und ') AS keyword,
       starts_with(lower(output), 'title') OR starts_with(lower(output), 'the') AS leads, regexp_matches(lower(text), '(^|[^a-z0-9])(in|of)\\s+the([^a-z0-9]|$)') AS phrase, output = '{{"error": "x"}}' OR contains(lower(output), 'connection refused') AS error_like,
       starts_with(lower(output), 'title:') AS title_like, array_to_string(list_filter(['title', 'rule', 'error'], lambda m: contains(lower(output), m)), '+') AS markers, rec = '{{"known_wrong": true}}' AND status = 'accepted' AS false_accept,
       status IN ('rejected', 'escalated', 'repaired') AS failed, regexp_replace(output, '^### RULE: ', '') AS bare, CASE WHEN trim(coalesce(flag, '')) = '' THEN role ELSE flag END AS filled, CASE WHEN regexp_matches(output, '[0-9]') THEN CAST(regexp_extract(output, '[+-]?[0-9]+') AS BIGINT) ELSE 0 END AS first_integer FROM x""")
def row_predicates(t):
    """Predicates and derived cells of evaluation rows."""
    x = t.conversations.select("conv_id", "turn", "role", "text", F.expr(_FLAG).alias("flag"), F.expr(_OUT).alias("output"), F.expr(_REC).alias("rec"), F.expr(_STATUS).alias("status"))
    out = F.col("output")
    return x.select(
        "conv_id", "turn", P.included(x, "flag").alias("included"), P.included(x, "flag", blank=True).alias("included_blank"), P.outside(F.col("role"), ("user", "assistant")).alias("outside"), P.contains_any(F.col("text"), ("the ", " und ")).alias("keyword"),
        P.starts_with_any(out, ("title", "the")).alias("leads"), (P.has_phrase(F.col("text"), "in the") | P.has_phrase(F.col("text"), "of the")).alias("phrase"), P.error_like(out).alias("error_like"), P.title_like(out).alias("title_like"),
        F.array_join(P.markers(out, ("title", "rule", "error")), "+").alias("markers"), P.false_accept(F.col("rec"), F.col("status")).alias("false_accept"), P.failed(F.col("status"), F.lit("NOT_RULED_OUT")).alias("failed"),
        P.without_heading(out, ("RULE", "CLAIM")).alias("bare"), P.filled(F.col("flag"), F.col("role")).alias("filled"), P.first_integer(out).alias("first_integer"),
    )
