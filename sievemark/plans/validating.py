"""Queries: what outputs hold, and validators of JSON, tool calls, code and grounded answers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import extraction as X
from ..functions import grounding as G
from ..operators import json_rows as V
from .query import query
from .tokens import _ELEMENT, _LIST, _Q

#: Objects without objects in them, told by a pattern: a quote behind the brace, then names with numbers or texts up to the first closing brace.
_FLAT = r'\{\s*"[a-z]+":\s*(?:[0-9]+|"[^"]*")(?:,\s*"[a-z]+":\s*(?:[0-9]+|"[^"]*"))*\}'
_OUT = """'{margin:0} of ' || event_type || CASE WHEN user_id % 3 = 0 THEN ' {"k": } {"a: 1} ' ELSE ' ' END || CASE WHEN value < 8 THEN '{"user": ' || user_id || ', "of": "}"} ' ELSE '' END
    || CASE WHEN user_id % 2 = 0 THEN '```' || event_type || '``` ```json ' || props || ' ```' WHEN user_id % 5 > 0 THEN props || ' {"z": 0}' ELSE '' END"""


@query(rf"""
WITH o AS (SELECT event_id, {_OUT} AS s FROM events)
SELECT event_id, coalesce(nullif(regexp_extract(s, '```json\s*({_FLAT})\s*```', 1), ''), nullif(regexp_extract(s, '{_FLAT}'), '')) AS object FROM o""")
def extracted_objects(t):
    """The first JSON object of an output made of an event: in a fence, behind braces of other kinds and broken objects, or none."""
    return t.events.select("event_id", X.json_object(F.expr(_OUT)).alias("object"))


_PAGE = """html || ' {"url": "' || url || '"}'"""


@query(f"WITH o AS (SELECT page_id, {_PAGE} AS s FROM pages) SELECT page_id, nullif(regexp_extract(s, '{_FLAT}'), '') AS object FROM o")
def page_objects(t):
    """The first JSON object behind a whole page's styles, scripts and quotes."""
    return t.pages.select("page_id", X.json_object(F.expr(_PAGE)).alias("object"))


_CODE = """CASE WHEN turn % 2 = 0 THEN CASE WHEN conv_id % 3 = 0 THEN 'Here is it:' || chr(10) ELSE '' END || 'x_' || conv_id || CASE WHEN conv_id % 2 = 0 THEN ' = ' ELSE ' as ' END || turn || chr(10) || 'Note: ' || left(text, 40)
    ELSE left(text, 60) || ' ```' || CASE WHEN role = 'user' THEN 'python' ELSE '' END || chr(10) || 'y = ' || CASE WHEN conv_id % 4 = 0 THEN '[' ELSE '' END || turn || chr(10) || '```' END"""


@query(rf"""
WITH o AS (SELECT conv_id, turn, {_CODE} AS s FROM conversations), c AS (SELECT *, trim(regexp_replace(regexp_replace(s, '^(?i:here is|sure|below is|the code)[^\n]*\n', ''), '(?is)(?:^|\n)(?:note:|explanation:).*$', ''), ' ' || chr(9) || chr(10)) AS plain FROM o),
d AS (SELECT conv_id, turn, CASE WHEN regexp_matches(s, '(?s)```.*```') THEN nullif(trim(regexp_extract(s, '(?s)```(?i:python|py)?\s*(.*?)```', 1), ' ' || chr(9) || chr(10)), '') WHEN regexp_matches(plain, '(?:def|class|import|from|return|for|while|if) |=') THEN plain END AS code FROM c)
SELECT conv_id, turn, code, CASE WHEN code IS NULL THEN 'UNCHECKABLE' WHEN regexp_full_match(code, '[a-z_0-9]+ = [0-9]+') THEN 'NOT_RULED_OUT' ELSE 'RULED_OUT_WRONG' END AS verdict FROM d""")
def extracted_code(t):
    """Code out of outputs made of turns, and whether it parses; what can't be extracted is never ruled out."""
    made = t.conversations.select("conv_id", "turn", X.code(F.expr(_CODE.replace("chr(10)", r"'\n'"))).alias("code"))
    verdict = F.when(F.col("code").isNull(), "UNCHECKABLE").when(X.syntax_error("code").isNull(), "NOT_RULED_OUT").otherwise("RULED_OUT_WRONG")
    return made.select("conv_id", "turn", "code", verdict.alias("verdict"))


@query("SELECT event_id, '{\"id\":' || event_id || ',\"k\":' || (event_id % 5) || ',\"n\":{\"a\":\"\\u00fc\",\"b\":[1,2]}}' AS canonical, sha256('{\"id\":' || event_id || ',\"k\":' || (event_id % 5) || ',\"n\":{\"a\":\"\\u00fc\",\"b\":[1,2]}}')[1:16] AS decision_id FROM events")
def canonical_records(t):
    """JSON in its canonical form, and the identifier that is its hash."""
    raw = F.concat(F.lit('{"n": {"b": [1, 2], "a": "ü"}, "k": '), (F.col("event_id") % 5).cast("string"), F.lit(', "id": '), F.col("event_id").cast("string"), F.lit("}"))
    c = t.events.select("event_id", X.canonical_json(raw).alias("canonical"))
    return c.select("event_id", "canonical", F.substring(F.sha2("canonical", 256), 1, 16).alias("decision_id"))


_SCHEMA = {
    "type": "object", "required": ["id", "score"], "additionalProperties": False,
    "properties": {"id": {"enum": ["click", "view", None]}, "score": {"type": "integer", "minimum": 3, "maximum": 120}, "props": {"type": "object", "properties": {"k": {"type": "number", "maximum": 80}}}, "tags": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"type": "string"}}, "a.b$c": {"type": "string"}},
}
_S = """CASE WHEN event_id % 29 = 0 THEN '[' || props || ']' WHEN event_id % 31 = 0 THEN props || ',' ELSE '{"id": "' || event_type || '"' || CASE WHEN value > 30 THEN '' ELSE ', "score": ' || user_id || CASE WHEN event_id % 17 = 0 THEN '.0' ELSE '' END END || ', "props": ' || props
    || CASE event_id % 5 WHEN 0 THEN ', "tags": ["' || event_type || '", ' || user_id || ']' WHEN 1 THEN ', "tags": []' ELSE '' END || CASE event_id % 7 WHEN 0 THEN ', "zeal": 1, "mood": 2' WHEN 1 THEN ', "a.b$c": ' || user_id ELSE '' END || '}' END"""
_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


@query(f"""
SELECT event_id, CASE WHEN event_id % 29 = 0 THEN '$ expected object, got array' WHEN event_id % 31 = 0 THEN 'invalid JSON' WHEN value > 30 THEN '$ missing required key ''score''' WHEN event_type NOT IN ('click', 'view') THEN '$.id value ''' || event_type || ''' not in enum [''click'', ''view'', None]'
    WHEN event_id % 17 = 0 THEN '$.score expected integer, got number' WHEN user_id < 3 THEN '$.score below minimum 3' WHEN user_id > 120 THEN '$.score above maximum 120' WHEN {_K} > 80 THEN '$.props.k above maximum 80'
    WHEN event_id % 5 = 0 THEN '$.tags[1] expected string, got integer' WHEN event_id % 5 = 1 THEN '$.tags has fewer than minItems=1' WHEN event_id % 7 = 1 THEN '$.a.b$c expected string, got integer' WHEN event_id % 7 = 0 THEN '$ unexpected key ''zeal''' END AS error FROM events""")
def schema_errors(t):
    """The first violation of a schema with nested parts by each event's record; true is no number, 1.0 no integer, keys have any signs."""
    return V.schema_errors(t.events.select("event_id", F.expr(_S).alias("raw")), "event_id", "raw", _SCHEMA)


_TOOL_SCHEMA = {"type": "object", "properties": {"path": {"type": "string"}, "when": {"type": "string", "format": "date"}, "n": {"type": "integer", "minimum": 0}}}
_DAY = "'2023-02-' || lpad(CAST(user_id AS VARCHAR(9)), 2, '0')"
_ARGS = f"""'{{"deep": [' || props || ', {{"path": "' || CASE WHEN value > 20 THEN '../' WHEN value > 15 THEN '/etc/' ELSE '' END || event_type || '"}}], "when": "' || {_DAY} || '", "n": ' || CASE WHEN event_id % 6 = 0 THEN '"x"' WHEN event_id % 11 = 0 THEN 'NaN' ELSE '' || (user_id - 1) END || '}}'"""
_CALL = f"""CASE event_id % 9 WHEN 0 THEN '{{"tool_call": {{"tool": "' || event_type || '", "args": ' || {_ARGS} || '}}}}' WHEN 1 THEN '{{"name": "' || event_type || '"}}' WHEN 2 THEN '{{"name": ' || user_id || ', "arguments": ' || props || '}}' WHEN 3 THEN '[' || props || ']' WHEN 4 THEN '{{"name": "' || event_type || '", "arguments": [' || props || ']}}'
    ELSE '{{"name": "' || event_type || '", "arguments": ' || {_ARGS} || '}}' END"""


@query(f"""
SELECT event_id, CASE event_id % 9 WHEN 1 THEN 'arguments missing' WHEN 2 THEN 'tool name missing' WHEN 3 THEN 'tool call must be a JSON object' WHEN 4 THEN 'arguments must parse as JSON object' ELSE
    CASE WHEN event_type NOT IN ('click', 'view') THEN 'disallowed tool: ' || event_type WHEN event_id % 6 = 0 THEN 'schema violation: $.arguments.n expected integer, got string' WHEN event_id % 11 = 0 THEN 'schema violation: $.arguments.n expected integer, got number' WHEN user_id < 1 THEN 'schema violation: $.arguments.n below minimum 0'
    WHEN value > 20 THEN 'unsafe path at $.deep[1].path: ../' || event_type WHEN value > 15 THEN 'unsafe path at $.deep[1].path: /etc/' || event_type WHEN TRY_CAST({_DAY} AS DATE) IS NULL THEN 'invalid ISO date at $.when: ' || {_DAY} END END AS error FROM events""")
def tool_call_errors(t):
    """Tool calls proposed by events: the first reason to refuse each."""
    return V.tool_call_errors(t.events.select("event_id", F.expr(_CALL).alias("raw")), "event_id", "raw", _TOOL_SCHEMA, ("click", "view"))


_ANSWER = "CASE turn % 4 WHEN 0 THEN text || ' [1]' WHEN 1 THEN 'In 2027 Berlin had ' || left(text, 40) || ' 12.5' WHEN 2 THEN 'so it is' ELSE left(text, 60) || ' [doc:3]' END"
_SOURCE = "lag(text) OVER (PARTITION BY conv_id ORDER BY turn)"
_CONTENTS = lambda c: f"list_distinct(list_filter(list_transform(regexp_extract_all({c}, {_Q(G.CONTENT)}), lambda x: lower(x)), lambda x: length(x) > 2 AND x NOT IN ({_LIST(G.STOP)})))"


@query(f"""
WITH x AS (SELECT conv_id, turn, {_ANSWER} AS a, coalesce({_SOURCE}, '') AS src FROM conversations), k AS (SELECT conv_id, turn, src, unnest(regexp_extract_all(a, {_Q(G.TOKENS)})) AS k FROM x), e AS (SELECT *, {_ELEMENT} AS element FROM k WHERE NOT starts_with(k, '[')),
m AS (SELECT DISTINCT conv_id, turn, k, element = 'ENTITY' AS entity, contains(lower(src), lower(k)) AS there FROM e WHERE element IN ('ENTITY', 'NUMBER', 'DATE')),
g AS (SELECT conv_id, turn, string_agg(k, ', ' ORDER BY lower(k), k) FILTER (WHERE entity AND NOT there) AS ents, string_agg(k, ', ' ORDER BY lower(k), k) FILTER (WHERE NOT entity AND NOT there) AS nums FROM m GROUP BY 1, 2),
f AS (SELECT x.conv_id, x.turn, g.conv_id IS NULL AS nothing, list_filter(['missing entities: ' || ents, 'missing numbers/dates: ' || nums, CASE WHEN NOT regexp_matches(a, {_Q(G.CITATION)}) THEN 'missing citation marker' END, CASE WHEN NOT list_has_any({_CONTENTS('a')}, {_CONTENTS('src')}) THEN 'no non-trivial evidence overlap' END], lambda r: r IS NOT NULL) AS failed
    FROM x LEFT JOIN g ON g.conv_id = x.conv_id AND g.turn = x.turn)
SELECT conv_id, turn, CASE WHEN nothing THEN 'UNCHECKABLE' WHEN len(failed) > 0 THEN 'RULED_OUT_WRONG' ELSE 'NOT_RULED_OUT' END AS verdict, CASE WHEN nothing THEN 'no checkable entities, numbers, or dates in answer' WHEN len(failed) > 0 THEN array_to_string(failed, '; ') ELSE 'answer is grounded in source' END AS reason FROM f""")
def grounded_answers(t):
    """Turns as answers to the turn before them: entities, quantities, citation and shared content."""
    source = F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    x = t.conversations.select("conv_id", "turn", F.expr(_ANSWER).alias("a"), source.alias("src"))
    return x.select("conv_id", "turn", G.check(F.col("a"), F.col("src")).alias("c")).select("conv_id", "turn", "c.verdict", "c.reason")
