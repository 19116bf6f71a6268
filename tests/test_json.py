"""JSON objects in texts, schemas and tool calls as rows, against the plain parser."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from sievemark.functions import extraction, text
from sievemark.operators import json_rows
from sievemark.plans import registry


def objects(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, s string").select("id", extraction.json_object(F.col("s")).alias("o"))
    found = dict(map(tuple, df.collect()))
    return [found[i] for i in range(len(texts))]


def plain_object(text):
    """The text of the first object: in a fence, else the first that the parser reads from a brace on."""
    at = 0
    while (at := text.find("```", at)) >= 0:
        begin = at + 3 + (4 if text[at + 3 : at + 7].lower() == "json" else 0)
        begin += len(text[begin:]) - len(text[begin:].lstrip())
        if text[begin : begin + 1] == "{":
            end = begin + 1
            while (end := text.find("```", end)) >= 0:
                inner = text[begin:end].rstrip()
                if len(inner) > 1 and inner[-1] == "}":
                    try:
                        json.loads(inner)
                        return inner
                    except ValueError:
                        pass
                    break
                end += 3
            break
        at += 1
    for i, c in enumerate(text):
        if c == "{" and text[i + 1 :].lstrip()[:1] in ('"', "}") and text[i + 1 :].lstrip():
            try:
                return text[i : json.JSONDecoder().raw_decode(text, i)[1]]
            except ValueError:
                continue
    return None


def test_first_objects_of_given_texts(spark):
    cases = {
        '```[1]``` {"q": 1}': '{"q": 1}', '{"s":"plain"}\n```json\n{"s":"fenced"}\n```': '{"s":"fenced"}', '{"s":"plain"}\n```json\n{broken}\n```\n```json\n{"s":"later"}\n```': '{"s":"plain"}',
        '{"a: 1} then {"ok": true}': '{"ok": true}', r'{"a": "\"}"} x': r'{"a": "\"}"}', '} ] {"k": [1, {"b": {}}]} {': '{"k": [1, {"b": {}}]}', '{"n": NaN, "i": -Infinity}': '{"n": NaN, "i": -Infinity}', '{ }': "{ }", "{": None, "": None, None: None, '{"a": [}]}': None, '{"a": {"b": 1}': '{"b": 1}',
    }
    assert objects(spark, list(cases)) == list(cases.values())


def test_first_objects_of_random_texts(spark):
    rng = random.Random(11)
    parts = ['{', '}', '[', ']', '"', '"a"', ': ', '1', ', ', '{"k": 1}', '{}', '\\', '\\"', '```', '```json\n', ' ', '\n', 'x', '{"b": "}"}', "null", 'true', '{"c": [1, 2]}', 'é']
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(3_000)]
    found = objects(spark, texts)
    wrong = [(t, f, plain_object(t)) for t, f in zip(texts, found) if f != plain_object(t)]
    assert not wrong, wrong[:5]


def test_long_texts_take_no_longer_than_their_length(spark):
    texts = ["```{{" * 20_000 + '{"safe":true}', '{"a": ' * 2_000 + "!" + "}" * 2_000, "{" * 100_000, "[{" * 50_000 + '{"x": 1}', '{"' * 50_000, '"{' * 50_000 + '"']
    objects(spark, texts[:1])
    begun = time.time()
    found = objects(spark, texts)
    assert found == ['{"safe":true}', None, None, '{"x": 1}', None, None]
    assert time.time() - begun < 20


def errors(spark, texts, schema):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, raw string")
    found = dict(map(tuple, json_rows.schema_errors(df, "id", "raw", schema).collect()))
    return [found[i] for i in range(len(texts))]


def plain_error(value, schema, path="$"):
    names = {dict: "object", list: "array", str: "string", bool: "boolean", int: "integer", float: "number", type(None): "null"}
    kind = names[type(value)]
    wanted = schema.get("type", kind)
    if kind not in (wanted if isinstance(wanted, list) else [wanted]) and not (kind == "integer" and "number" in (wanted if isinstance(wanted, list) else [wanted])):
        return f"{path} expected {wanted}, got {kind}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{path} value {value!r} not in enum {schema['enum']!r}"
    if kind == "object":
        for k in schema.get("required", []):
            if k not in value:
                return f"{path} missing required key {k!r}"
        for k, inner in schema.get("properties", {}).items():
            if k in value and (e := plain_error(value[k], inner, f"{path}.{k}")):
                return e
        if schema.get("additionalProperties") is False:
            for k in value:
                if k not in schema.get("properties", {}):
                    return f"{path} unexpected key {k!r}"
    if kind == "array":
        if len(value) < schema.get("minItems", 0):
            return f"{path} has fewer than minItems={schema['minItems']}"
        if len(value) > schema.get("maxItems", 1e9):
            return f"{path} has more than maxItems={schema['maxItems']}"
        for i, x in enumerate(value):
            if "items" in schema and (e := plain_error(x, schema["items"], f"{path}[{i}]")):
                return e
    if kind in ("integer", "number"):
        if value < schema.get("minimum", -1e99):
            return f"{path} below minimum {schema['minimum']}"
        if value > schema.get("maximum", 1e99):
            return f"{path} above maximum {schema['maximum']}"
    return None


SCHEMA = {
    "type": "object", "required": ["a"], "additionalProperties": False,
    "properties": {"b.c": {"type": "array", "minItems": 1, "maxItems": 3, "items": {"type": ["integer", "object"], "maximum": 5, "properties": {"x": {"type": "array", "items": {"enum": ["u", 1, None]}}}}}, "a": {"type": ["number", "null", "string"], "minimum": -2}, 'q"$': {"type": "boolean"}},
}


def test_first_violations_are_those_of_a_walk(spark):
    rng = random.Random(12)

    def value(depth):
        kind = rng.randrange(9 if depth else 6)
        scalar = [None, True, rng.randrange(-4, 8), rng.randrange(-4, 8) / 2, rng.choice("uvw"), 1][kind % 6]
        if kind < 6:
            return scalar
        return [value(depth - 1) for _ in range(rng.randrange(5))] if kind < 7 else {rng.choice(["a", "b.c", 'q"$', "x", "z", "y"]): value(depth - 1) for _ in range(rng.randrange(4))}

    values = [{k: value(3) for k in rng.sample(["a", "b.c", 'q"$', "z"], rng.randrange(1, 4))} for _ in range(1_500)] + [value(3) for _ in range(300)]
    values += [{"a": 1, "b.c": [{"x": ["u", True, 1.0, rng.choice([None, "w"])]}]} for _ in range(50)]
    expected = [plain_error(v, SCHEMA) for v in values]
    assert len({e.split("[")[0] for e in expected if e}) > 12 and sum(e is None for e in expected) > 30
    composite = [i for i, e in enumerate(expected) if e and " value " in e and (" value {" in e or " value [" in e)]
    found = errors(spark, [json.dumps(v) for v in values], SCHEMA)
    wrong = [(values[i], found[i], expected[i]) for i in range(len(values)) if found[i] != expected[i] and i not in composite]
    assert not wrong, wrong[:5]


def test_schemas_and_texts_at_their_edges(spark):
    deep = '{"a": ' * 100_000
    texts = [None, "", "nope", '{"a": 1}', '{"a": ' + "9" * 5_000 + "}", deep, '{"a": NaN}', '{"a": null, "a": 2}']
    assert errors(spark, texts, {"required": ["a"], "properties": {"a": {"type": "integer", "maximum": 10}}}) == ["invalid JSON", "invalid JSON", "invalid JSON", None, "$.a above maximum 10", "invalid JSON", "$.a expected integer, got number", None]
    with pytest.raises(ValueError, match="unsupported"):
        errors(spark, [], {"type": "many"})
    assert errors(spark, ["[1]", "2"], {}) == [None, None]


def test_tool_calls(spark):
    schema = {"properties": {"n": {"minimum": 0}, "d": {"format": "date-time"}, "l": {"type": "array", "items": {"type": "date"}}}}
    cases = {
        '{"name": "x", "arguments": {"p": ["a", {"q": "../b"}]}}': "unsafe path at $.p[1].q: ../b", '{"name": "x", "arguments": {"n": -1}}': "schema violation: $.arguments.n below minimum 0", '{"name": "x", "arguments": {"n": NaN}}': "impossible number at $.n: NaN/Infinity",
        '{"name": "x", "arguments": {"z": -Infinity, "p": "/etc/x"}}': "impossible number at $.z: NaN/Infinity", '{"name": "x", "arguments": {"p": "c:\\\\Users\\\\a", "z": NaN}}': "unsafe path at $.p: c:\\Users\\a", '{"name": "x", "arguments": {"d": "2020-01-01T10:00:00Z", "l": ["2024-02-29"]}}': None,
        '{"name": "x", "arguments": {"l": ["2024-02-29", "2023-02-29"]}}': "invalid ISO date at $.l[1]: 2023-02-29", '{"name": "x", "arguments": {"d": "2020-01-01T25:00"}}': "invalid ISO date at $.d: 2020-01-01T25:00", '{"tool": "x", "args": "{\\"p\\": \\"ok\\"}"}': None, '{"tool": "rm", "args": {}}': "disallowed tool: rm",
        '{"tool_call": [1]}': "tool call must be a JSON object", '{"name": "", "arguments": {}}': "tool name missing", '{"name": "x"}': "arguments missing", '{"name": "x", "arguments": "[1]"}': "arguments must parse as JSON object", '{"name": "x", "arguments": null}': "arguments must parse as JSON object",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "id long, raw string")
    found = dict(map(tuple, json_rows.tool_call_errors(df, "id", "raw", schema, ("x",)).collect()))
    assert [found[i] for i in range(len(cases))] == list(cases.values())
    broken = spark.createDataFrame([(1, "{nope"), (2, None), (3, '{"name": "x", "arguments": "{"}')], "id long, raw string")
    said = dict(map(tuple, json_rows.tool_call_errors(broken, "id", "raw").collect()))
    assert said[1].startswith("tool call JSON invalid: ") and said[2] == "tool call JSON invalid" and said[3].startswith("arguments JSON invalid: ")


def test_plans_stay_small(spark):
    path = "/root/testdata/sf0.001"
    for name in ("tool_call_errors", "schema_errors"):
        plan = registry.queries()[name](spark, path)._jdf.queryExecution().optimizedPlan().toString()
        assert len(plan) < 100_000


def test_answer_integers(spark):
    cases = {
        "The final result that I get is 42, see page 7": "42,".rstrip(","), "analysis complete; final answer: 12,345": "12345", "final " * 50_000: None, "final5 then answer--6": "-6", '{"ANSWER": "1,000 2"} answer 3': "10002", "no label 1 and -2": "-2", "": None, None: None, "final9": "9", "answer - 5": "5",
        "x 3 " + "final " * 50_000: "3",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "id long, s string").select("id", text.answer_integer(F.col("s")).alias("x"))
    found = dict(map(tuple, df.collect()))
    assert [found[i] for i in range(len(cases))] == list(cases.values())


def test_plain_objects_need_no_scan_of_all_signs(spark, sf_dir):
    """Where plain objects decide, braces and quotes aren't paired: never in the outputs made of events."""
    from sievemark.plans import validating

    cases = {'{margin:0} of x {"k": } {"user": 3, "of": "}"} {"z": 0}': '{"user": 3, "of": "}"}', "{ } {}": "{ }", '{"k": } {"a: 1} {"k": 76} {"z": 0}': '{"k": 76}', '{"k": } {"l" 1}': None, '{"a": [{"b": 1}]}': "{", "no { brace": None}
    df = spark.createDataFrame([(s,) for s in cases], "s string")
    assert {r[0]: r[1] for r in df.select("s", extraction._plain_first(F.col("s"))).collect()} == cases
    outputs = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.expr(validating._OUT).alias("s"))
    assert outputs.filter(extraction._plain_first(F.col("s")) == "{").count() == 0
