"""Queries: extractions, decision records and prompts held against their contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import contracts as C
from .query import query
from .tokens import _ELEMENT, _LIST, _Q

_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"
_ROLE = f"CASE WHEN {_K} > 60 THEN ' claim ' WHEN {_K} > 40 THEN upper(event_type) WHEN {_K} > 20 THEN 'RESULT' ELSE 'BACKGROUND' END"
_EXTRACTION = f"""CASE WHEN user_id % 11 = 0 THEN '{{"error": "' || event_type || '"}}' WHEN user_id % 11 = 1 THEN '{{"k": ' || {_K} || '}}' ELSE '{{"role": "' || {_ROLE} || '", "entities": ' || CASE WHEN user_id % 2 = 0 THEN '"' || upper(event_type) || '; u' || user_id || ';' || event_type || '"' ELSE '["U' || user_id || '", " u' || user_id || ' "]' END
    || ', "operative_status": "' || CASE WHEN value > 20 THEN 'active' ELSE 'idle' END || '", "relation": "' || CASE WHEN {_K} % 2 = 0 THEN 'asserts' ELSE event_type || 's' END || '", "rationale": "' || CASE WHEN value > 100 THEN 'Max retries exceeded' ELSE 'r' END || '"}}' END"""
_GOT = "trim(coalesce(json_extract_string(s, '$.{n}'), '{d}'))"


@query(f"""
WITH x AS (SELECT event_id, user_id, event_type, {_EXTRACTION} AS s FROM events), f AS (SELECT *, upper({_GOT.format(n='role', d='BACKGROUND')}) AS role, upper({_GOT.format(n='operative_status', d='DESCRIPTIVE')}) AS status, {_GOT.format(n='relation', d='sets_context')} AS relation, {_GOT.format(n='rationale', d='')} AS rationale,
    CASE WHEN NOT contains(s, '"entities"') THEN [] WHEN user_id % 2 = 0 THEN [event_type, 'u' || user_id] ELSE ['u' || user_id] END AS es FROM x),
e AS (SELECT *, CASE WHEN contains(s, '"error"') OR contains(lower(s), 'max retries exceeded') THEN ['provider_error_like_output'] ELSE list_filter([CASE WHEN NOT contains(s, '"role"') THEN 'default_empty_extraction' END, CASE WHEN role NOT IN ({_LIST(C.ROLES)}) THEN 'invalid role: ' || role END, CASE WHEN status NOT IN ({_LIST(C.STATUSES)}) THEN 'invalid operative_status: ' || status END, CASE WHEN relation NOT IN ({_LIST(C.RELATIONS)}) THEN 'invalid relation: ' || relation END], lambda y: y IS NOT NULL) END AS errors FROM f)
SELECT event_id, role, array_to_string(es, '+') AS entities, len(errors) = 0 AS valid, array_to_string(errors, '; ') AS errors FROM e""")
def validated_extractions(t):
    """Extractions made of events, normalised, with what is wrong with each."""
    e = t.events.select("event_id", C.extraction(F.expr(_EXTRACTION)).alias("e"))
    return e.select("event_id", "e.role", F.array_join("e.entities", "+").alias("entities"), "e.valid", F.array_join("e.errors", "; ").alias("errors"))


_RECORD = """'{"schema_version": "' || CASE WHEN event_id % 11 = 1 THEN 'v0' ELSE 'harness_decision_v1' END || '", "decision_id": "' || CASE WHEN event_id % 11 = 2 THEN '' ELSE 'd' END || '", "timestamp": "t", "task_type": "' || CASE WHEN event_id % 11 = 3 THEN 'poem' ELSE 'unknown' END || '", "route_family": "grounding", "verdict": "UNCHECKABLE", "action": "'
    || CASE WHEN event_id % 11 = 4 THEN 'accept' ELSE 'escalate' END || '", "final_status": "escalated", "validator": "", "reason": ' || CASE WHEN event_id % 11 = 5 THEN '7' ELSE '"r"' END || ', "input_hash": "h", "repair_attempt": ' || CASE event_id % 11 WHEN 6 THEN '-1' WHEN 7 THEN '1.5' ELSE '0' END
    || CASE WHEN event_id % 11 = 8 THEN '' ELSE ', "latency_ms": 1.5' END || CASE WHEN event_id % 11 = 9 THEN ', "zeal": 1, "mood": 2' ELSE '' END || CASE WHEN event_id % 11 = 10 THEN '' ELSE '}' END"""


@query("""
SELECT event_id, CASE event_id % 11 WHEN 1 THEN 'schema_version must be ''harness_decision_v1''' WHEN 2 THEN 'decision_id must not be empty' WHEN 3 THEN 'task_type must be one of arithmetic, json_schema, tool_call, grounded_qa, python_code, extraction, long_context_qa, retrieval, unknown' WHEN 4 THEN 'empty validator is allowed only when action=escalate on unknown'
    WHEN 5 THEN 'reason must be string' WHEN 6 THEN 'repair_attempt must be >= 0' WHEN 7 THEN 'repair_attempt must be integer' WHEN 8 THEN 'missing harness decision fields: latency_ms' WHEN 9 THEN 'unexpected harness decision fields: mood, zeal' WHEN 10 THEN 'not a JSON object' END AS error FROM events""")
def decision_record_errors(t):
    """Decision records with one fault each, and the first breach that is found."""
    raw = F.expr(_RECORD)
    return t.events.select("event_id", F.when(F.try_parse_json(raw).isNull(), "not a JSON object").otherwise(C.record_error(raw)).alias("error"))


_PROMPT = "CASE item_id % 3 WHEN 0 THEN 'Write a list: never exceed 3 items. ' WHEN 1 THEN 'Explain in JSON why risk is at most 5%. ' ELSE '' END || text"
_GATHER = lambda kinds: f"list_transform(list_sort(list_transform(list_filter(es, lambda x: x.e IN ({_LIST(kinds)}) AND x.f), lambda x: {{'p': x.p, 'k': x.k}})), lambda y: y.k)"


@query(f"""
WITH p AS (SELECT item_id, regexp_extract_all({_PROMPT}, {_Q(C.PROMPT_TOKENS)}) AS ks FROM benchmark), k AS (SELECT item_id, unnest(range(len(ks))) AS pos, unnest(ks) AS k FROM p), e AS (SELECT *, {_ELEMENT} AS e, row_number() OVER (PARTITION BY item_id, k ORDER BY pos) = 1 AS f FROM k),
g AS (SELECT item_id, list({{'p': pos, 'k': k, 'e': e, 'f': f}}) AS es FROM e GROUP BY 1), j AS (SELECT item_id, array_to_string({_GATHER(C.INSTRUCTING)}, ', ') AS i, array_to_string({_GATHER(C.PRESERVED)}, ', ') AS k, array_to_string({_GATHER(C.CONSTRAINING)}, ', ') AS c, len(list_filter(es, lambda x: lower(x.k) = 'json')) > 0 AS js, len(list_filter(es, lambda x: lower(x.k) = 'list')) > 0 AS li FROM g)
SELECT item_id, 'Task: ' || CASE WHEN i = '' THEN 'answer' ELSE i END || '.' || chr(10) || 'Preserve exactly: ' || CASE WHEN k = '' THEN 'none detected' ELSE k END || '.' || chr(10) || 'Constraints: ' || CASE WHEN c = '' THEN 'none detected' ELSE c END || '.' || chr(10) || 'Return: ' || CASE WHEN js THEN 'valid JSON' WHEN li THEN 'a concise list' ELSE 'a direct, checkable answer' END || '.' AS structured FROM j""")
def structured_prompts(t):
    """Prompts rewritten from their own tokens: task, what to keep, constraints and format."""
    return t.benchmark.select("item_id", C.structured_prompt(F.expr(_PROMPT)).alias("p")).select("item_id", "p.structured")
