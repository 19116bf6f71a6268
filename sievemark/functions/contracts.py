"""Contracts of extractions, decision records and prompts, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cells import ordered_distinct
from .elements import OUTER, element
from .predicates import ERROR_KEYS, ERROR_WORDS, contains_any

#: The labels of an extraction, and its defaults.
ROLES = ("BACKGROUND", "CLAIM", "DEFINE", "METHOD", "RESULT", "LIMITATION", "NEXT_STEP", "EXAMPLE")
STATUSES = ("ACTIVE", "CONDITIONAL", "LIMITED", "NEGATED", "DESCRIPTIVE")
RELATIONS = ("sets_context", "defines", "asserts", "recommends", "reports_usefulness", "limits", "warns_about", "gives_example", "proposes_next_test", "maps_to", "requires", "supports_retrieval")
RELEVANCE = ("YES", "NO", "MAYBE")
DEFAULTS = {"role": "BACKGROUND", "operative_status": "DESCRIPTIVE", "relation": "sets_context", "answer_relevant": "MAYBE", "rationale": ""}

#: The fields of a decision record with their kinds, and those that it must have.
RECORD_ENUMS = {
    "task_type": ("arithmetic", "json_schema", "tool_call", "grounded_qa", "python_code", "extraction", "long_context_qa", "retrieval", "unknown"),
    "route_family": ("digital_residue", "sound_checker", "grounding", "token_element", "embedding", "full_compute", "human_review"),
    "verdict": ("RULED_OUT_WRONG", "NOT_RULED_OUT", "UNCHECKABLE"), "action": ("accept", "repair", "retry", "escalate", "reject", "full_compute"), "final_status": ("accepted", "rejected", "escalated", "repaired", "failed"),
}
RECORD_TEXTS = ("decision_id", "timestamp", "reason", "input_hash")
RECORD_NUMBERS = ("repair_attempt", "latency_ms")
RECORD_FIELDS = ("schema_version", "decision_id", "timestamp", "task_type", "route_family", "verdict", "action", "final_status", "validator", "reason", "input_hash", "repair_attempt", "latency_ms")
RECORD_EXTRAS = ("model", "tokens", "cost_usd", "validator_record")

#: The pattern of prompt tokens, the elements that a structured prompt gathers, and the formats that words ask for.
PROMPT_TOKENS = r"https?://\S+|\[[0-9]+\]|[A-Za-z]+(?:n't)?|[+-]?[0-9]+(?:\.[0-9]+)?|[<>]=?|%|\S"
INSTRUCTING, PRESERVED, CONSTRAINING = ("INSTRUCT",), ("ENTITY", "NUMBER", "DATE", "NEGATION", "CITATION"), ("NEGATION", "THRESHOLD", "RISK")
FORMATS = {"json": "valid JSON", "csv": "CSV", "table": "a table", "list": "a concise list", "bullet": "a concise list"}


def extraction(raw: Column) -> Column:
    """struct(role, operative_status, relation, answer_relevant, entities, rationale, valid, errors) of an extraction's JSON: trimmed, in the case of its labels, with defaults for absent fields.

    Outputs that look like a provider's error are refused as such. Values that aren't JSON objects are the defaults, which are an error of their own.
    """
    field = lambda name: F.trim(F.coalesce(F.get_json_object(raw, f"$.{name}"), F.lit(DEFAULTS[name])))
    role, status, relation, relevant, rationale = F.upper(field("role")), F.upper(field("operative_status")), field("relation"), F.upper(field("answer_relevant")), field("rationale")
    entities = F.transform(ordered_distinct(F.get_json_object(raw, "$.entities")), F.lower)
    entities = F.array_distinct(entities)
    keys = F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>"))
    provider = (F.arrays_overlap(keys, F.array(*map(F.lit, ERROR_KEYS))) | (contains_any(raw, ERROR_WORDS) & (F.size(keys) > 0))) & ~F.array_contains(keys, "extraction")
    default = (role == "BACKGROUND") & (F.size(entities) == 0) & (status == "DESCRIPTIVE") & (relation == "sets_context") & (relevant == "MAYBE") & ((rationale == "") | contains_any(rationale, ERROR_WORDS))
    bad = lambda name, value, allowed: F.when(~value.isin(*allowed), F.concat(F.lit(f"invalid {name}: "), value))
    listed = F.array_compact(F.array(F.when(default, "default_empty_extraction"), bad("role", role, ROLES), bad("operative_status", status, STATUSES), bad("relation", relation, RELATIONS), bad("answer_relevant", relevant, RELEVANCE)))
    errors = F.when(provider, F.array(F.lit("provider_error_like_output"))).otherwise(listed)
    named = {"role": role, "operative_status": status, "relation": relation, "answer_relevant": relevant, "entities": entities, "rationale": rationale, "valid": F.size(errors) == 0, "errors": errors}
    return F.struct(*(c.alias(k) for k, c in named.items()))


def record_error(raw: Column) -> Column:
    """The first breach of the decision record's contract by a JSON text, or null: unexpected and missing fields, constants, enums, kinds, empty texts and negatives; an empty validator only where an unknown task escalates.

    Spark's parser reads the first JSON value of a text; what may stand behind it isn't looked at.
    """
    keys, v = F.json_object_keys(raw), F.try_parse_json(raw)
    names = lambda items: F.array(*map(F.lit, items))
    text = lambda k: F.try_variant_get(v, f"$.{k}", "string")
    kind = lambda k: F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant"))
    extra, missing = F.array_sort(F.array_except(keys, names((*RECORD_FIELDS, *RECORD_EXTRAS)))), F.array_except(names(RECORD_FIELDS), keys)
    found = [
        F.when(keys.isNull(), "not a JSON object"), F.when(F.size(extra) > 0, F.concat(F.lit("unexpected harness decision fields: "), F.array_join(extra, ", "))),
        F.when(F.size(missing) > 0, F.concat(F.lit("missing harness decision fields: "), F.array_join(missing, ", "))), F.when(text("schema_version") != "harness_decision_v1", "schema_version must be 'harness_decision_v1'"),
    ]
    for name in RECORD_FIELDS[1:]:
        if name in RECORD_ENUMS:
            found.append(F.when(~F.coalesce(text(name).isin(*RECORD_ENUMS[name]), F.lit(False)), f"{name} must be one of {', '.join(RECORD_ENUMS[name])}"))
        elif name in RECORD_NUMBERS:
            whole = kind(name) == "BIGINT" if name == "repair_attempt" else kind(name).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
            found += [F.when(~F.coalesce(whole, F.lit(False)), f"{name} must be {'integer' if name == 'repair_attempt' else 'number'}"), F.when(F.try_variant_get(v, f"$.{name}", "double") < 0, f"{name} must be >= 0")]
        else:
            found.append(F.when(F.coalesce(kind(name) != "STRING", F.lit(True)), f"{name} must be string"))
            if name in RECORD_TEXTS:
                found.append(F.when(text(name) == "", f"{name} must not be empty"))
    lone = (text("validator") == "") & ((text("action") != "escalate") | (text("task_type") != "unknown"))
    return F.coalesce(*found, F.when(lone, "empty validator is allowed only when action=escalate on unknown"))


def structured_prompt(prompt: Column, hint: Column | None = None) -> Column:
    """struct(structured, preserved): a prompt's instructions, what it must keep, its constraints and the format it asks for, from its own tokens alone."""
    tokens = F.regexp_extract_all(F.coalesce(prompt, F.lit("")), F.lit(f"({PROMPT_TOKENS})"), F.lit(1))

    def of(tagged: Column) -> Column:
        gathered = lambda kinds: F.array_distinct(F.transform(F.filter(tagged, lambda x: x["element"].isin(*kinds)), lambda x: x["token"]))
        joined = lambda kinds, none: F.coalesce(F.nullif(F.array_join(gathered(kinds), ", "), F.lit("")), none)
        words = F.transform(tagged, lambda x: F.regexp_replace(F.lower(x["token"]), OUTER, ""))
        asked = reduce(lambda c, kv: c.when(F.array_contains(words, kv[0]), kv[1]), FORMATS.items(), F.when(F.lit(False), "")).otherwise("a direct, checkable answer")
        task = joined(INSTRUCTING, F.coalesce(F.nullif(F.trim(hint), F.lit("")) if hint is not None else F.lit(None), F.lit("answer")))
        none = F.lit("none detected")
        text = F.concat(F.lit("Task: "), task, F.lit(".\nPreserve exactly: "), joined(PRESERVED, none), F.lit(".\nConstraints: "), joined(CONSTRAINING, none), F.lit(".\nReturn: "), asked, F.lit("."))
        return F.struct(text.alias("structured"), gathered(PRESERVED).alias("preserved"))

    tagged = F.transform(tokens, lambda k: F.struct(k.alias("token"), element(k).alias("element")))
    return F.element_at(F.transform(F.array(tagged), of), 1)
