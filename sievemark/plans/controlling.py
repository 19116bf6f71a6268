"""Queries: the control plane over decision rows made of events and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import control as C
from .query import query

#: A decision's parts out of an event: its task by type and user, its risk and budget by value, its outcome and validator by the number in its properties.
_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"
_TASK = "CASE event_type WHEN 'click' THEN 'arithmetic' WHEN 'view' THEN 'json_schema' WHEN 'purchase' THEN 'python_code' WHEN 'signup' THEN CASE WHEN user_id % 2 = 0 THEN 'grounded_qa' ELSE 'tool_call' END ELSE CASE user_id % 4 WHEN 0 THEN 'long_context_qa' WHEN 1 THEN 'unknown' WHEN 2 THEN 'extraction' ELSE 'retrieval' END END"
_RISK = "CASE WHEN value > 40 THEN 'high' ELSE 'low' END"
_BUDGET = "CASE WHEN value < 1 THEN 'full' ELSE 'balanced' END"
_OUTCOME = f"CASE WHEN {_K} > 75 THEN 'RULED_OUT_WRONG' WHEN {_K} > 40 THEN 'NOT_RULED_OUT' WHEN {_K} > 25 THEN 'accept' WHEN {_K} > 15 THEN 'FULL_COMPUTE' ELSE 'UNCHECKABLE' END"
_VALIDATOR = f"CASE {_K} % 4 WHEN 0 THEN 'answer_span_recall_guard' WHEN 1 THEN '' ELSE 'residue' END"
_D = f"""d AS (SELECT event_id, {_K} AS k, {_TASK} AS task, {_RISK} AS risk, {_BUDGET} AS budget, {_OUTCOME} AS outcome, {_VALIDATOR} AS validator FROM events),
v AS (SELECT *, CASE outcome WHEN 'accept' THEN 'NOT_RULED_OUT' WHEN 'FULL_COMPUTE' THEN 'UNCHECKABLE' ELSE outcome END AS verdict FROM d),
p AS (SELECT *, CASE WHEN risk = 'high' OR task = 'unknown' OR verdict = 'UNCHECKABLE' THEN 'escalate' WHEN verdict = 'RULED_OUT_WRONG' THEN 'reject' ELSE 'accept' END AS action FROM v)"""


def _decisions(t):
    d = t.events.select("event_id", F.expr(_K).alias("k"), F.expr(_TASK).alias("task"), F.expr(_RISK).alias("risk"), F.expr(_BUDGET).alias("budget"), F.expr(_OUTCOME).alias("outcome"), F.expr(_VALIDATOR).alias("validator"))
    v = d.withColumn("verdict", C.verdict_of(F.col("outcome")))
    return v.select("*", C.policy(F.col("verdict"), F.col("task"), F.col("risk")).alias("p")).select(*v.columns, "p.*")


@query(f"""
WITH {_D} SELECT event_id, verdict, action, CASE action WHEN 'accept' THEN 'accepted' WHEN 'reject' THEN 'rejected' ELSE 'escalated' END AS final_status, action <> 'accept' AS blocking,
       CASE WHEN risk = 'high' OR budget = 'full' OR task IN ('unknown', 'extraction') THEN 'full_compute' WHEN task = 'arithmetic' THEN 'digital_residue' WHEN task IN ('json_schema', 'tool_call', 'python_code') THEN 'sound_checker' WHEN task = 'grounded_qa' THEN 'grounding' WHEN task = 'retrieval' THEN 'embedding' ELSE 'token_element' END AS route_family,
       CASE WHEN risk = 'high' THEN 'risk=high forces FULL_COMPUTE_WITH_VALIDATOR' WHEN budget = 'full' THEN 'budget=full prefers full compute' WHEN task IN ('unknown', 'extraction') THEN 'unknown task has no safe guarded cheap path' WHEN task = 'arithmetic' THEN 'residue verifier returned ' || outcome WHEN task = 'long_context_qa' AND k = 0 THEN 'token route produced empty keep set' WHEN task = 'long_context_qa' THEN 'element route keeps ' || k || ' tokens and routes ' || printf('%.3f', (100 - k) / 100.0) || ' cheap' ELSE 'checked by ' || validator END AS reason FROM p""")
def harness_policy(t):
    """Outcome to verdict, verdict, task and risk to action, and the lane that each decision takes."""
    said = C.lane_reason(F.col("task"), F.col("outcome"), F.concat(F.lit("checked by "), "validator"), F.col("k"), 100 - F.col("k"))
    return _decisions(t).select("event_id", "verdict", "action", "final_status", "blocking", C.lane(F.col("task"), F.col("risk"), F.col("budget"), said).alias("l")).select("event_id", "verdict", "action", "final_status", "blocking", "l.*")


@query(f"""
WITH {_D}, e AS (SELECT *, CASE WHEN action = 'escalate' OR verdict = 'UNCHECKABLE' THEN CASE WHEN risk = 'high' THEN CASE WHEN task IN ('arithmetic', 'long_context_qa') THEN 'full_compute' ELSE 'human_review' END WHEN task = 'arithmetic' AND verdict = 'RULED_OUT_WRONG' THEN 'full_compute'
    WHEN verdict = 'UNCHECKABLE' AND task IN ('extraction', 'python_code') THEN 'stronger_model' WHEN task = 'long_context_qa' AND verdict = 'UNCHECKABLE' AND validator = 'answer_span_recall_guard' THEN 'full_compute' ELSE 'human_review' END END AS target FROM p)
SELECT event_id, target, action = 'accept' AND validator = '' AND target IS NULL AS unguarded FROM e""")
def escalation_targets(t):
    """Where each escalated decision goes, and the accepted ones that nothing guards."""
    d = _decisions(t)
    target = F.when((F.col("action") == "escalate") | (F.col("verdict") == C.UNCHECKABLE), C.escalation_target(F.col("task"), F.col("verdict"), F.col("risk"), F.col("validator"), with_model=True))
    return d.withColumn("target", target).select("event_id", "target", C.unguarded(F.col("action"), F.col("validator"), F.col("target")).alias("unguarded"))


_CHECKS = "list_filter([{'checker': 'a', 'verdict': CASE WHEN k % 3 = 0 THEN 'RULED_OUT_WRONG' ELSE 'NOT_RULED_OUT' END, 'reason': 'a' || k % 4}, {'checker': 'b', 'verdict': CASE k % 4 WHEN 0 THEN 'RULED_OUT_WRONG' WHEN 1 THEN 'UNCHECKABLE' ELSE 'NOT_RULED_OUT' END, 'reason': 'b'}, {'checker': 'c', 'verdict': 'UNCHECKABLE', 'reason': 'c'}], lambda x: (k + ascii(x.checker)) % 5 > 1)"


def _checks():
    k = F.col("k")
    one = lambda name, verdict, reason: F.struct(F.lit(name).alias("checker"), verdict.alias("verdict"), reason.alias("reason"))
    a = one("a", F.when(k % 3 == 0, C.WRONG).otherwise(C.OPEN), F.concat(F.lit("a"), (k % 4).cast("string")))
    b = one("b", F.when(k % 4 == 0, C.WRONG).when(k % 4 == 1, C.UNCHECKABLE).otherwise(C.OPEN), F.lit("b"))
    return F.filter(F.array(a, b, one("c", F.lit(C.UNCHECKABLE), F.lit("c"))), lambda x: (k + F.ascii(x["checker"])) % 5 > 1)


_N = lambda v: f"len(list_filter(checks, lambda x: x.verdict = '{v}'))"


@query(f"""
WITH {_D}, c AS (SELECT p.*, {_CHECKS} AS checks, event_id % 3 AS attempts FROM p), r AS (SELECT *, CASE WHEN {_N('RULED_OUT_WRONG')} > 0 THEN 'RULED_OUT_WRONG' ELSE 'NOT_RULED_OUT' END AS routed FROM c),
s AS (SELECT *, CASE WHEN verdict = 'UNCHECKABLE' THEN 0 WHEN len(checks) > 0 THEN (len(checks) - {_N('UNCHECKABLE')})::DOUBLE / len(checks) ELSE 1 END AS cov, CASE WHEN len(checks) > 0 THEN {_N('RULED_OUT_WRONG')} ELSE CASE WHEN verdict = 'RULED_OUT_WRONG' THEN 1 ELSE 0 END END AS hard FROM r)
SELECT event_id, routed, CASE WHEN routed = 'RULED_OUT_WRONG' THEN array_to_string(list_transform(list_filter(checks, lambda x: x.verdict = 'RULED_OUT_WRONG'), lambda x: x.reason), '; ') ELSE 'no applicable checker ruled out this output' END AS reason, round(cov, 6) AS validation_coverage, hard AS hard_failures,
       CASE WHEN len(checks) > 0 THEN {_N('UNCHECKABLE')} ELSE CASE WHEN verdict = 'UNCHECKABLE' THEN 1 ELSE 0 END END AS unchecked_claims, attempts AS repair_attempts, verdict = 'UNCHECKABLE' OR action = 'escalate' AS escalation_required,
       CASE WHEN task <> 'grounded_qa' THEN 'n/a' WHEN {_N('NOT_RULED_OUT')} = 0 THEN 'none' WHEN {_N('NOT_RULED_OUT')} = len(checks) - {_N('UNCHECKABLE')} THEN 'full' ELSE 'partial' END AS source_grounding,
       CAST(CAST(round_even(cov * 100, 0) AS INTEGER) AS VARCHAR) || '% of this output was covered by checkable routes; ' || hard || ' hard failures; ' || attempts || CASE WHEN attempts = 1 THEN ' repair.' ELSE ' repairs.' END AS summary FROM s""")
def decision_scorecards(t):
    """Checks joined to one verdict, and the scorecard of each decision."""
    d = _decisions(t).withColumn("checks", _checks()).withColumn("attempts", F.col("event_id") % 3)
    card = C.scorecard(F.col("verdict"), F.col("checks"), F.col("attempts"), F.col("action"), F.col("final_status"), F.col("task"))
    r = d.select("event_id", C.routed(F.col("checks")).alias("r"), card.alias("s"))
    return r.select("event_id", F.col("r.verdict").alias("routed"), "r.reason", F.round("s.validation_coverage", 6).alias("validation_coverage"), *(f"s.{c}" for c in ("hard_failures", "unchecked_claims", "repair_attempts", "escalation_required", "source_grounding", "summary")))


@query(f"""
WITH {_D}, w AS (SELECT event_id AS decision_id, task, verdict FROM p WHERE verdict <> 'NOT_RULED_OUT'), a AS (SELECT decision_id, n AS attempt, CASE (decision_id + n * 3) % 4 WHEN 0 THEN 'NOT_RULED_OUT' WHEN 1 THEN 'UNCHECKABLE' ELSE 'RULED_OUT_WRONG' END AS verdict, CASE WHEN (decision_id + n) % 8 = 5 THEN ['score'] ELSE [] END AS damaged FROM w, range(1, 4) r(n) WHERE n <= 1 + decision_id % 3),
t AS (SELECT decision_id, min(attempt) FILTER (WHERE verdict = 'NOT_RULED_OUT' AND len(damaged) = 0) AS first_ok, max(attempt) AS last, arg_max(verdict, attempt) AS ev, arg_max(damaged, attempt) AS ed FROM a WHERE attempt <= 2 GROUP BY 1),
j AS (SELECT w.*, t.*, task IN ('arithmetic', 'json_schema', 'tool_call', 'python_code') AS can, first_ok IS NOT NULL AS done FROM w LEFT JOIN t ON t.decision_id = w.decision_id), x AS (SELECT *, can AND NOT done AND task = 'arithmetic' AND coalesce(ev, verdict) = 'RULED_OUT_WRONG' AS exact FROM j)
SELECT decision_id, CAST(CASE WHEN NOT can THEN 0 WHEN done THEN first_ok ELSE last + CASE WHEN exact THEN 1 ELSE 0 END END AS BIGINT) AS tried, CASE WHEN can THEN CAST(first_ok AS BIGINT) END AS attempt, CASE WHEN NOT can THEN 'escalate' WHEN exact THEN 'full_compute' ELSE 'repair' END AS action, CASE WHEN can AND done THEN 'repaired' ELSE 'escalated' END AS final_status,
       CASE WHEN NOT can THEN 'repair unsupported for task_type=' || task WHEN done THEN 'repaired' WHEN exact THEN 'repair exhausted; exact value computed' WHEN len(ed) > 0 THEN 'repair rejected: previously valid fields became invalid: score' ELSE 'repair exhausted' END AS reason FROM x""")
def repair_outcomes(t):
    """Attempts as rows: the first that passes and damages nothing, else an exact value, else escalation."""
    w = _decisions(t).filter(F.col("verdict") != C.OPEN).select(F.col("event_id").alias("decision_id"), F.col("task").alias("task_type"), "verdict")
    e = F.col("decision_id")
    a = w.select("decision_id", F.explode(F.sequence(F.lit(1), (1 + e % 3).cast("int"))).alias("attempt"))
    kind = (e + F.col("attempt") * 3) % 4
    damaged = F.when((e + F.col("attempt")) % 8 == 5, F.array(F.lit("score"))).otherwise(F.array().cast("array<string>"))
    a = a.select("decision_id", "attempt", F.when(kind == 0, C.OPEN).when(kind == 1, C.UNCHECKABLE).otherwise(C.WRONG).alias("verdict"), damaged.alias("damaged"))
    return C.repaired(w, a)


@query(f"""
WITH {_D} SELECT event_id, CASE WHEN task = 'arithmetic' THEN 'Your answer ''' || event_id || ''' fails an exact consistency check: off. Recompute this problem and respond with ONLY the integer.' || chr(10) || 'Problem: p'
    WHEN task = 'json_schema' AND verdict = 'UNCHECKABLE' THEN 'Your previous response did not yield a checkable JSON object. Return ONLY a JSON object satisfying the schema.' || chr(10) || 'Task: p' WHEN task = 'json_schema' THEN 'Your JSON violates the schema: off. Return ONLY corrected JSON satisfying the schema.' || chr(10) || 'Task: p' || chr(10) || 'Previous JSON: ' || event_id
    WHEN verdict = 'UNCHECKABLE' THEN 'Your previous response did not yield checkable Python code. Return ONLY corrected Python code, no explanation.' || chr(10) || 'Task: p' ELSE 'Your code has a syntax error or parse failure: off. Return ONLY corrected Python code, no explanation.' || chr(10) || 'Task: p' || chr(10) || 'Previous code: ' || event_id END AS prompt FROM p""")
def repair_prompts(t):
    return _decisions(t).select("event_id", C.repair_prompt(F.col("task"), F.col("verdict"), F.col("event_id").cast("string"), F.lit("off"), F.lit("p")).alias("prompt"))


_PAYLOAD = f"""CASE user_id % 14 WHEN 0 THEN '{{"task_type": "retrieval", "k": ' || {_K} || '}}' WHEN 1 THEN '{{"tool_call": ' || props || '}}' WHEN 2 THEN '{{"name": "' || event_type || '", "args": ' || props || '}}' WHEN 3 THEN '{{"answer": "' || event_type || '", "source": ' || props || '}}' WHEN 4 THEN '{{"expr": "' || user_id || '*' || {_K} || '", "claimed_answer": ' || event_id || '}}'
    WHEN 5 THEN '{{"raw": "' || event_type || '", "schema": ' || props || '}}' WHEN 6 THEN '{{"code": "' || event_type || '"}}' WHEN 7 THEN '{{"passage": "' || event_type || '", "question": ""}}' WHEN 8 THEN '{{"query": "' || event_type || '", "corpus": []}}' WHEN 9 THEN 'what is ' || user_id || '^' || {_K} || ' mod 7' WHEN 10 THEN 'see ```' || event_type || '```'
    WHEN 11 THEN 'is a ' || event_type || ' of user ' || user_id || ' a question that has more than eight words?' WHEN 12 THEN 'a bare ' || event_type ELSE CASE WHEN {_K} % 2 = 0 THEN '' ELSE repeat(event_type || ' ', 13) END END"""


@query(rf"""
WITH p AS (SELECT event_id, {_PAYLOAD} AS s FROM events), j AS (SELECT *, CASE WHEN starts_with(s, '{{') THEN json_keys(s) ELSE [] END AS ks FROM p)
SELECT event_id, CASE WHEN starts_with(s, '{{') THEN CASE WHEN list_contains(ks, 'task_type') THEN json_extract_string(s, '$.task_type') WHEN list_contains(ks, 'tool_call') OR list_has_all(ks, ['name', 'args']) THEN 'tool_call' WHEN list_has_all(ks, ['answer', 'source']) THEN 'grounded_qa' WHEN list_has_all(ks, ['expr', 'claimed_answer']) THEN 'arithmetic'
    WHEN list_has_all(ks, ['raw', 'schema']) THEN 'json_schema' WHEN list_contains(ks, 'code') THEN 'python_code' WHEN list_has_all(ks, ['passage', 'question']) THEN 'long_context_qa' WHEN list_has_all(ks, ['query', 'corpus']) THEN 'retrieval' END
    WHEN regexp_matches(s, '\bmod [0-9]+\b') THEN 'arithmetic' WHEN contains(s, '```') THEN 'python_code' WHEN contains(s, '?') AND len(string_split(trim(s), ' ')) > 8 THEN 'long_context_qa' WHEN trim(s) <> '' AND len(string_split(trim(s), ' ')) <= 12 THEN 'retrieval' ELSE 'unknown' END AS task FROM j""")
def payload_tasks(t):
    """The task that each payload made of an event states, by its keys, else by the shape of its text."""
    return t.events.select("event_id", C.task_type(F.expr(_PAYLOAD)).alias("task"))


@query("""
WITH r AS (SELECT vec_id, list_transform(embedding[1:8], lambda x: abs(x::DOUBLE)) AS dense, list_transform(range(8), lambda i: CASE WHEN i % 2 = 0 THEN abs(embedding[i + 1]::DOUBLE) ELSE 0 END) AS budget FROM embeddings),
s AS (SELECT *, list_sum(list_transform(dense, lambda x: x + 1e-9)) AS ds, list_sum(list_transform(budget, lambda x: x + 1e-9)) AS bs FROM r), k AS (SELECT *, list_sum(list_transform(range(1, 9), lambda i: (dense[i] + 1e-9) / ds * ln((dense[i] + 1e-9) / ds / ((budget[i] + 1e-9) / bs)))) AS kl FROM s)
SELECT 2 * count(*) AS guard_checks, CAST(sum(CASE WHEN kl > 0.1 THEN 1 ELSE 0 END + CASE WHEN list_max(budget) < 0.15 THEN 1 ELSE 0 END) AS BIGINT) AS guard_triggers, CAST(sum(len(list_filter(range(8), lambda i: i % 2 = 1 AND dense[i + 1] > 0.02))) AS BIGINT) AS false_prunes,
       round(sum(CASE WHEN kl > 0.1 THEN 1 ELSE 0 END + CASE WHEN list_max(budget) < 0.15 THEN 1 ELSE 0 END) / (2 * count(*))::DOUBLE, 6) AS guard_trigger_rate FROM k""")
def guard_counts(t):
    """Guards of a pruned attention: divergence, confidence, and places dropped although they weigh."""
    dense = F.transform(F.slice("embedding", 1, 8), lambda x: F.abs(x.cast("double")))
    budget = F.transform(dense, lambda x, i: F.when(i % 2 == 0, x).otherwise(0.0))
    rows = t.embeddings.select(dense.alias("dense"), budget.alias("budget"), F.array(*(F.lit(i) for i in range(0, 8, 2))).alias("kept"))
    return C.guard_counters(rows).withColumn("guard_trigger_rate", F.round("guard_trigger_rate", 6))


@query("""
WITH o AS (SELECT conv_id, 'm' || turn % 3 AS model, min(text) AS output FROM conversations GROUP BY 1, 2) SELECT p.conv_id AS prompt_id, m.model, o.output, o.output IS NOT NULL AS available FROM (SELECT DISTINCT conv_id FROM conversations) p CROSS JOIN (VALUES ('m0'), ('m1'), ('m2'), ('m3')) m(model) LEFT JOIN o ON o.conv_id = p.conv_id AND o.model = m.model""")
def model_comparison(t):
    """Every prompt under every model; those without output stay visible."""
    outputs = t.conversations.select(F.col("conv_id").alias("prompt_id"), F.concat(F.lit("m"), (F.col("turn") % 3).cast("string")).alias("model"), F.col("text").alias("output"))
    return C.compared(t.conversations.select(F.col("conv_id").alias("prompt_id")).distinct(), outputs, ["m0", "m1", "m2", "m3"])
