"""The control plane over decision rows: routing, policy, repair, escalation, scorecards and guards. No model is called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import pick

WRONG, OPEN, UNCHECKABLE = "RULED_OUT_WRONG", "NOT_RULED_OUT", "UNCHECKABLE"

#: Task types, the lane of each, what can be repaired, and what full computation covers.
LANES = {
    "arithmetic": "digital_residue", "json_schema": "sound_checker", "tool_call": "sound_checker", "grounded_qa": "grounding", "python_code": "sound_checker", "extraction": "explicit_escalation",
    "long_context_qa": "token_element", "retrieval": "embedding", "unknown": "human_review",
}
REPAIRABLE, COMPUTABLE = ("arithmetic", "json_schema", "tool_call", "python_code"), ("arithmetic", "long_context_qa")

#: What each checker covers, and an example of what it can't see.
COVERAGE = [
    ("residues", "Rules out claims that differ from the true value modulo the bank.", "An error that is a multiple of all moduli."),
    ("json_schema", "Rules out invalid JSON and violations of type, required, enum and range.", "A value that fits the schema and is wrong."),
    ("python_code", "Rules out code that doesn't parse.", "Code that parses and does something else."),
    ("grounding", "Rules out entities, numbers and dates that the source doesn't hold.", "A wrong claim made of words of the source."),
]


def routed(checks: Column) -> Column:
    """struct(verdict, reason) of an array of struct(checker, verdict, reason): any check may rule out; without one nothing is ruled out."""
    wrong = F.filter(checks, lambda c: c["verdict"] == WRONG)
    reason = F.when(F.size(wrong) > 0, F.array_join(F.transform(wrong, lambda c: c["reason"]), "; ")).otherwise("no applicable checker ruled out this output")
    return F.struct(F.when(F.size(wrong) > 0, WRONG).otherwise(OPEN).alias("verdict"), reason.alias("reason"))


def task_type(payload: Column) -> Column:
    """The task that a payload states, by a task_type of its own, then its keys, then the shape of its text."""
    keys = F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>"))
    has = lambda *names: F.arrays_overlap(keys, F.array(*map(F.lit, names)))
    own, text = F.get_json_object(payload, "$.task_type"), F.trim(payload)
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    by_keys = (
        F.when(own.isin(*[t for t in LANES if t != "extraction"]), own).when(has("tool_call") | (has("name", "tool") & has("arguments", "args")), "tool_call").when(has("answer") & has("source", "sources"), "grounded_qa")
        .when(has("expr") & has("claimed_answer"), "arithmetic").when(has("raw") & has("schema"), "json_schema").when(has("code") | F.coalesce(F.get_json_object(payload, "$.raw").contains("```"), F.lit(False)), "python_code")
        .when(has("passage") & has("question"), "long_context_qa").when(has("query") & has("documents", "corpus"), "retrieval")
    )
    by_text = (
        F.when(text.rlike(r"(?i)\bmod\s+[0-9]+\b") | text.rlike(r"[0-9]\s*(?:\*\*|\^|\+|\*|!)"), "arithmetic").when(text.contains("```"), "python_code").when(text.startswith("{") & F.lower(text).contains("schema"), "json_schema")
        .when(text.contains("?") & (words > 8), "long_context_qa").when((text != "") & (words <= 12), "retrieval").otherwise("unknown")
    )
    return F.coalesce(by_keys, by_text)


def lane_reason(task: Column, outcome: Column, checked: Column, kept: Column, cheap: Column, router: str = "element") -> Column:
    """Why a guarded lane decides as it does: the residues' outcome, the tokens that the router keeps and routes cheaply, or what the checker said (checked)."""
    share = F.format_string("%.3f", cheap / F.greatest(kept + cheap, F.lit(1)))
    routed = F.when(kept > 0, F.concat(F.lit(f"{router} route keeps "), kept.cast("string"), F.lit(" tokens and routes "), share, F.lit(" cheap"))).otherwise("token route produced empty keep set")
    return F.when(task == "arithmetic", F.concat(F.lit("residue verifier returned "), outcome)).when(task == "long_context_qa", routed).otherwise(checked)


def lane(task: Column, risk: Column, budget: Column, said: Column | None = None) -> Column:
    """struct(route_family, reason): high risk and a full budget come first; a task without a cheap guarded path is escalated; said is the lane's own lane_reason()."""
    said = F.concat(F.lit("guarded lane of "), task) if said is None else said
    family = F.create_map(*(F.lit(x) for pair in LANES.items() for x in pair))
    return (
        F.when(risk == "high", F.struct(F.lit("full_compute").alias("route_family"), F.lit("risk=high forces FULL_COMPUTE_WITH_VALIDATOR").alias("reason")))
        .when(budget == "full", F.struct(F.lit("full_compute").alias("route_family"), F.lit("budget=full prefers full compute").alias("reason")))
        .when(~task.isin("arithmetic", "json_schema", "python_code", "tool_call", "grounded_qa", "long_context_qa", "retrieval"), F.struct(F.lit("full_compute").alias("route_family"), F.lit("unknown task has no safe guarded cheap path").alias("reason")))
        .otherwise(F.struct(F.element_at(family, task).alias("route_family"), said.alias("reason")))
    )


def verdict_of(outcome: Column) -> Column:
    return F.when(outcome.isin(WRONG, OPEN, UNCHECKABLE), outcome).when(outcome == "accept", OPEN).otherwise(UNCHECKABLE)


def policy(verdict: Column, task: Column, risk: Column) -> Column:
    """struct(action, final_status, blocking)."""
    escalate = (risk == "high") | (task == "unknown")
    action = F.when(escalate, "escalate").when(verdict == WRONG, "reject").when(verdict == OPEN, "accept").otherwise("escalate")
    status = F.when(action == "reject", "rejected").when(action == "accept", "accepted").otherwise("escalated")
    return F.struct(action.alias("action"), status.alias("final_status"), (action != "accept").alias("blocking"))


def escalation_target(task: Column, verdict: Column, risk: Column, validator: Column, with_model: bool = False) -> Column:
    """Where an escalated decision goes."""
    return (
        F.when(risk == "high", F.when(task.isin(*COMPUTABLE), "full_compute").otherwise("human_review")).when(task == "unknown", "human_review").when((task == "arithmetic") & (verdict == WRONG), "full_compute")
        .when((verdict == UNCHECKABLE) & task.isin("extraction", "python_code"), "stronger_model" if with_model else "human_review")
        .when((task == "long_context_qa") & (verdict == UNCHECKABLE) & (validator == "answer_span_recall_guard"), "full_compute").otherwise("human_review")
    )


def unguarded(action: Column, validator: Column, target: Column) -> Column:
    """Whether a decision lets an output pass without a validator or an escalation target: there must be none."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    return action.isin("accept", "repair") & blank(validator) & blank(target)


def repaired(decisions: DataFrame, attempts: DataFrame, most: int = 2) -> DataFrame:
    """Per decision (decision_id, task_type, verdict): the outcome of its attempts (decision_id, attempt, verdict, damaged: fields that were valid before).

    The first attempt of at most `most` that isn't ruled out and damages nothing repairs it. Without one, arithmetic is computed
    exactly, anything else is escalated; tasks that can't be repaired are escalated without attempts. Columns: decision_id, tried, attempt, action, final_status, reason.
    """
    tried = attempts.filter((F.col("attempt") >= 1) & (F.col("attempt") <= most)).withColumn("ok", (F.col("verdict") == OPEN) & (F.size("damaged") == 0))
    per = tried.groupBy("decision_id").agg(F.min(F.when(F.col("ok"), F.col("attempt"))).alias("first_ok"), F.max("attempt").alias("last"), F.max_by(F.struct("verdict", "damaged"), "attempt").alias("end"))
    d = decisions.join(per, "decision_id", "left")
    can, done, damaged = F.col("task_type").isin(*REPAIRABLE), F.col("first_ok").isNotNull(), F.coalesce(F.size("end.damaged"), F.lit(0)) > 0
    exact = can & ~done & (F.col("task_type") == "arithmetic") & (F.coalesce("end.verdict", "verdict") == WRONG)
    reason = (
        F.when(~can, F.concat(F.lit("repair unsupported for task_type="), F.col("task_type"))).when(done, "repaired").when(exact, "repair exhausted; exact value computed")
        .when(damaged, F.concat(F.lit("repair rejected: previously valid fields became invalid: "), F.array_join("end.damaged", ", "))).otherwise("repair exhausted")
    )
    count = F.when(~can, 0).when(done, F.col("first_ok")).otherwise(F.coalesce("last", F.lit(0)) + exact.cast("int"))
    return d.select("decision_id", count.cast("long").alias("tried"), F.when(can & done, F.col("first_ok")).cast("long").alias("attempt"), F.when(can & done, "repair").when(exact, "full_compute").otherwise(F.when(can, "repair").otherwise("escalate")).alias("action"), F.when(can & done, "repaired").otherwise("escalated").alias("final_status"), reason.alias("reason"))


#: The sentences of repair prompts are those that models were asked with.
def repair_prompt(domain: Column, verdict: Column, shown: Column, reason: Column, prompt: Column) -> Column:
    """What a repairing model is asked, by domain and verdict."""
    unread = verdict == UNCHECKABLE
    return (
        F.when(domain == "arithmetic", F.format_string("Your answer '%s' fails an exact consistency check: %s. Recompute this problem and respond with ONLY the integer.\nProblem: %s", shown, reason, prompt))
        .when((domain == "json_schema") & unread, F.format_string("Your previous response did not yield a checkable JSON object. Return ONLY a JSON object satisfying the schema.\nTask: %s", prompt))
        .when(domain == "json_schema", F.format_string("Your JSON violates the schema: %s. Return ONLY corrected JSON satisfying the schema.\nTask: %s\nPrevious JSON: %s", reason, prompt, shown))
        .when(unread, F.format_string("Your previous response did not yield checkable Python code. Return ONLY corrected Python code, no explanation.\nTask: %s", prompt))
        .otherwise(F.format_string("Your code has a syntax error or parse failure: %s. Return ONLY corrected Python code, no explanation.\nTask: %s\nPrevious code: %s", reason, prompt, shown))
    )


def scorecard(verdict: Column, checks: Column, attempts: Column, action: Column, final_status: Column, task: Column) -> Column:
    """struct(validation_coverage, hard_failures, unchecked_claims, repair_attempts, escalation_required, source_grounding, summary) of a decision and its checks (array of struct with verdict)."""
    n = lambda v: F.size(F.filter(checks, lambda c: c["verdict"] == v))
    some, all_ = F.size(checks) > 0, F.size(checks)
    coverage = F.when(verdict == UNCHECKABLE, 0.0).when(some, (all_ - n(UNCHECKABLE)) / all_).when(F.coalesce(verdict, F.lit("")) != "", 1.0).otherwise(0.0)
    hard = F.when(some, n(WRONG)).otherwise((verdict == WRONG).cast("int")).cast("long")
    unchecked = F.when(some, n(UNCHECKABLE)).otherwise((verdict == UNCHECKABLE).cast("int")).cast("long")
    applicable = all_ - n(UNCHECKABLE)
    grounding = F.when(task != "grounded_qa", "n/a").when(n(OPEN) == 0, "none").when(n(OPEN) == applicable, "full").otherwise("partial")
    summary = F.concat(F.bround(coverage * 100).cast("int").cast("string"), F.lit("% of this output was covered by checkable routes; "), hard.cast("string"), F.lit(" hard failures; "), attempts.cast("string"), F.when(attempts == 1, " repair.").otherwise(" repairs."))
    return F.struct(coverage.alias("validation_coverage"), hard.alias("hard_failures"), unchecked.alias("unchecked_claims"), attempts.alias("repair_attempts"), ((verdict == UNCHECKABLE) | (action == "escalate") | (final_status == "escalated")).alias("escalation_required"), grounding.alias("source_grounding"), summary.alias("summary"))


def kl_divergence(p: Column, q: Column, eps: float = 1e-9) -> Column:
    """Divergence of q from p, two arrays of weights of one length."""
    whole = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v + eps)
    term = lambda a, b: (a + eps) / whole(p) * F.log((a + eps) / whole(p) / ((b + eps) / whole(q)))
    return F.aggregate(F.zip_with(p, q, term), F.lit(0.0), lambda s, v: s + v)


def guard_counters(checked: DataFrame, kl_threshold: float = 0.10, least_confidence: float = 0.15, tau: float = 0.02) -> DataFrame:
    """One row: guard_checks, guard_triggers, guard_trigger_rate, false_prunes over rows (dense, budget: weights; kept: places).

    A row is checked twice: by divergence, and by the budget's highest weight. A dropped place of a weight over tau is pruned falsely.
    """
    pruned = F.size(F.filter(F.transform("dense", lambda w, i: (w > tau) & ~F.array_contains("kept", i)), lambda x: x))
    hits = (kl_divergence(F.col("dense"), F.col("budget")) > kl_threshold).cast("long") + (F.array_max("budget") < least_confidence).cast("long")
    found = checked.agg((2 * F.count("*")).alias("guard_checks"), F.coalesce(F.sum(hits), F.lit(0)).alias("guard_triggers"), F.coalesce(F.sum(pruned), F.lit(0)).alias("false_prunes"))
    return found.withColumn("guard_trigger_rate", F.col("guard_triggers") / F.greatest(F.col("guard_checks"), F.lit(1)))


def coverage_report(spark) -> DataFrame:
    """checker, coverage, blind_spot."""
    return spark.createDataFrame(COVERAGE, "checker string, coverage string, blind_spot string")


def compared(prompts: DataFrame, outputs: DataFrame, models: list[str]) -> DataFrame:
    """A row of every prompt (prompt_id) and model with its output (prompt_id, model, output); a model without one is not available and hides no other."""
    wanted = prompts.select("prompt_id", F.explode(F.array(*map(F.lit, models))).alias("model"))
    return wanted.join(pick(outputs, ["prompt_id", "model"], F.asc("output")), ["prompt_id", "model"], "left").withColumn("available", F.col("output").isNotNull())


def agent_steps(proposals: DataFrame, most: int = 1) -> DataFrame:
    """Proposals (run_id, step, error, repair_error) of tool calls: final_status of each step up to `most`, and nothing after the first that isn't ready.

    A call that is refused may be proposed anew once (repair_error: of that); refused again it escalates.
    """
    status = F.when(F.col("error").isNull(), "ready").when(F.col("repair_error").isNull(), "repaired").otherwise("escalated")
    before = Window.partitionBy("run_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    judged = proposals.filter(F.col("step") <= most).withColumn("final_status", status)
    return judged.withColumn("stopped", F.coalesce(F.bool_or(F.col("final_status") == "escalated").over(before), F.lit(False))).filter("NOT stopped").drop("stopped")
