"""JSON texts as rows (path, kind, value), and schemas as rule rows that are joined with them.

A text is parsed once and laid out in the order of its own keys; everything after that is a join with a few rule rows,
however deep texts and schemas are. A violation carries its place in the order in which a walk would meet it, so
that the first one is a minimum.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.extraction import SYSTEM_PREFIXES

#: The types that a schema may ask for.
TYPES = ("object", "array", "string", "integer", "number", "boolean", "null")
#: Integers of more digits count as beyond any bound.
LONGEST_INTEGER = 4_000
#: Rows that are passed on at once.
ROWS = 5_000

_FIELDS = "pos int, path string, rule string, indexes array<int>, kind string, names array<string>, items int, number double, text string, same string, shown string"
_NAMES = [f.split()[0] for f in _FIELDS.split(", ")]


def _integer(digits: str) -> int:
    return int(digits) if len(digits) <= LONGEST_INTEGER else 10**400 * (-1 if digits.startswith("-") else 1)


def _number(value: float) -> float:
    try:
        return float(value)
    except OverflowError:
        return float("inf") if value > 0 else float("-inf")


def walked(value: Any) -> Iterator[tuple]:
    """The rows of a parsed value, parents before their children, children in their own order."""
    todo, pos = [(value, "$", "$", ())], 0
    while todo:
        value, path, rule, indexes = todo.pop()
        kind, names, items, number, text, same = "null", None, None, None, None, "null"
        if isinstance(value, dict):
            kind, names, same = "object", list(value), None
            todo += [(v, f"{path}.{k}", f"{rule}.{json.dumps(k)}", indexes) for k, v in reversed(value.items())]
        elif isinstance(value, list):
            kind, items, same = "array", len(value), None
            todo += [(v, f"{path}[{i}]", f"{rule}[]", (*indexes, i)) for i, v in reversed(list(enumerate(value)))]
        elif isinstance(value, str):
            kind, text, same = "string", value, "s" + value
        elif value is not None:
            kind, number = "boolean" if isinstance(value, bool) else "integer" if isinstance(value, int) else "number", _number(value)
            same = "n" + repr(number)
        yield pos, path, rule, list(indexes), kind, names, items, number, text, same, repr(value) if same else kind
        pos += 1


def _parsed(raw: str | None) -> Any:
    return json.loads(raw, parse_int=_integer)


def _call(raw: str | None) -> tuple[str | None, Any, str | None]:
    """Name, arguments and error of a proposed call: wrapped in tool_call or not, name or tool, arguments or args, as an object or as its text."""
    try:
        call = _parsed(raw)
    except json.JSONDecodeError as e:
        return None, None, f"tool call JSON invalid: {e.msg}"
    except (TypeError, ValueError, RecursionError):
        return None, None, "tool call JSON invalid"
    if isinstance(call, dict) and "tool_call" in call:
        call = call["tool_call"]
    if not isinstance(call, dict):
        return None, None, "tool call must be a JSON object"
    name = call.get("name", call.get("tool"))
    if not isinstance(name, str) or not name:
        return None, None, "tool name missing"
    if "arguments" not in call and "args" not in call:
        return name, None, "arguments missing"
    given = call["arguments"] if "arguments" in call else call["args"]
    if isinstance(given, str):
        try:
            given = _parsed(given)
        except json.JSONDecodeError as e:
            return name, None, f"arguments JSON invalid: {e.msg}"
        except (ValueError, RecursionError):
            return name, None, "arguments JSON invalid"
    return (name, given, None) if isinstance(given, dict) else (name, None, "arguments must parse as JSON object")


def _document(raw: str | None) -> tuple[str | None, Any, str | None]:
    try:
        return None, _parsed(raw), None
    except (TypeError, ValueError, RecursionError):
        return None, None, "invalid JSON"


def rows(df: DataFrame, key: str, raw: str, calls: bool = False) -> DataFrame:
    """key, tool, error, and for each value of a text its row: pos, path, rule (path without indexes), indexes, kind, names (of an object), items (of an array), number, text, same (equal for equal scalars), shown.

    A null or broken text has one row with its error. With calls, texts are proposed tool calls: tool is the name, and
    the rows are those of the arguments. NaN and infinities are numbers, as lenient writers mean them.
    """
    key_type, take = df.schema[key].dataType.simpleString(), _call if calls else _document
    schema = pa.schema([("tool", pa.string()), ("error", pa.string()), ("pos", pa.int32()), ("path", pa.string()), ("rule", pa.string()), ("indexes", pa.list_(pa.int32())), ("kind", pa.string()), ("names", pa.list_(pa.string())), ("items", pa.int32()), ("number", pa.float64()), ("text", pa.string()), ("same", pa.string()), ("shown", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, owner = [], []

            def batch(b=b):
                columns = [pa.array(c, f.type) for c, f in zip(zip(*found), schema)]
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner)), *columns], ["key", *schema.names])

            for i, text in enumerate(b.column(1).to_pylist()):
                tool, value, error = take(text)
                for row in [(None,) * len(_NAMES)] if error else walked(value):
                    found.append((tool, error, *row))
                    owner.append(i)
                    if len(found) == ROWS:
                        yield batch()
                        found, owner = [], []
            if found:
                yield batch()

    return df.select(F.col(key).alias("key"), F.col(raw).cast("string").alias("raw")).mapInArrow(run, f"key {key_type}, tool string, error string, {_FIELDS}")


def rules(schema: dict[str, Any], rule: str = "$", place: tuple[int, ...] = (), depth: int = 0) -> Iterator[dict[str, Any]]:
    """The rule rows of a schema (type, enum, required, properties, additionalProperties, items and their number, minimum, maximum, format). place orders violations; -n in it stands for a value's n-th index."""
    made = lambda what, *at, **more: {"rule": rule, "what": what, "place": [*place, *at], **more}
    if "type" in schema and schema["type"] != "date":
        wanted = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        if unknown := set(wanted) - set(TYPES):
            raise ValueError(f"unsupported schema type: {sorted(unknown)}")
        yield made("type", 0, texts=[*wanted, *(["integer"] if "number" in wanted else [])], said=f" expected {schema['type']}, got ")
    if "enum" in schema:
        yield made("enum", 1, texts=["null" if x is None else "s" + x if isinstance(x, str) else "n" + repr(_number(x)) for x in schema["enum"]], said=f" not in enum {schema['enum']!r}")
    for i, name in enumerate(schema.get("required", [])):
        yield made("required", 2, i, texts=[name], said=f" missing required key {name!r}")
    for i, (name, inner) in enumerate(schema.get("properties", {}).items()):
        yield from rules(inner, f"{rule}.{json.dumps(name)}", (*place, 3, i), depth)
    if schema.get("additionalProperties") is False:
        yield made("additional", 4, texts=list(schema.get("properties", {})), said=" unexpected key ")
    for what, at in (("minItems", 5), ("maxItems", 6)):
        if what in schema:
            yield made(what, at, bound=float(schema[what]), said=f" has {'fewer' if at == 5 else 'more'} than {what}={schema[what]}")
    if "items" in schema:
        yield from rules(schema["items"], f"{rule}[]", (*place, 7, -1 - depth), depth + 1)
    for what, at in (("minimum", 8), ("maximum", 9)):
        if what in schema:
            yield made(what, at, bound=float(schema[what]), said=f" {'below' if at == 8 else 'above'} {what} {schema[what]}")
    if schema.get("format") in ("date", "date-time") or schema.get("type") == "date":
        yield made("date")


_RULES = "rule string, what string, place array<int>, texts array<string>, bound double, said string"


def _ruled(found: DataFrame, schema: dict[str, Any]) -> DataFrame:
    """The rows beside the rules of their paths (none: one row without a rule). There are as many rules as the schema has words."""
    listed = [tuple(r.get(c) for c in ("rule", "what", "place", "texts", "bound", "said")) for r in rules(schema)]
    return found.join(F.broadcast(found.sparkSession.createDataFrame(listed, _RULES)), "rule", "left")


def _violation(root: str) -> Column:
    """What a row breaks of its rule: the message, or null."""
    c = F.col
    extra = F.try_element_at(F.filter("names", lambda x: ~F.array_contains("texts", x)), F.lit(1))
    is_number = c("kind").isin("integer", "number")
    says = lambda *parts: F.concat(F.lit(root), F.substring("path", 2, 2**30), *parts)
    broken = (
        F.when((c("what") == "type") & ~F.array_contains("texts", c("kind")), says("said", "kind"))
        .when((c("what") == "enum") & ~F.coalesce(F.array_contains("texts", c("same")), F.lit(False)), says(F.lit(" value "), "shown", "said"))
        .when((c("what") == "required") & (c("kind") == "object") & ~F.array_contains("names", F.get("texts", F.lit(0))), says("said"))
        .when((c("what") == "additional") & extra.isNotNull(), says("said", F.lit("'"), extra, F.lit("'")))
        .when((c("what") == "minItems") & (c("items") < c("bound")) | (c("what") == "maxItems") & (c("items") > c("bound")), says("said"))
        .when(is_number & ((c("what") == "minimum") & (c("number") < c("bound")) | (c("what") == "maximum") & (c("number") > c("bound")) & ~F.isnan("number")), says("said"))
    )
    return broken


def _place() -> Column:
    return F.transform("place", lambda x: F.when(x < 0, F.get("indexes", -x - 1)).otherwise(x))


def iso_date(text: Column) -> Column:
    """Whether a text is an ISO date, or with a T a date and time (Z or an offset behind it or not)."""
    day = r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{8}"
    shape = rf"^(?:{day})(?:T[0-9]{{2}}(?::?[0-9]{{2}}(?::?[0-9]{{2}}(?:[.,][0-9]+)?)?)?(?:Z|[+-][0-9]{{2}}:?[0-9]{{2}})?)?$"
    digits = F.regexp_replace(F.regexp_extract(text, rf"^({day})", 1), "-", "")
    clock = F.regexp_extract(text, "T([0-9]{2}):?([0-9]{2})?:?([0-9]{2})?", 0)
    part = lambda n: F.coalesce(F.regexp_extract(clock, "T([0-9]{2}):?([0-9]{2})?:?([0-9]{2})?", n).try_cast("int"), F.lit(0))
    return text.rlike(shape) & F.try_to_date(digits, "yyyyMMdd").isNotNull() & ((clock == "") | (part(1) < 24) & (part(2) < 60) & (part(3) < 60))


def _unsafe() -> Column:
    """What is unsafe about a row: the message, or null."""
    c = F.col
    low = F.lower("text")
    path = F.array_contains(F.split("text", r"[\\/]"), "..") | c("text").rlike(r"^[\\/]|^[A-Za-z]:[\\/]")
    for prefix in SYSTEM_PREFIXES:
        path = path | low.startswith(prefix)
    says = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    return (
        F.when((c("kind") == "string") & path, says("unsafe path at ", c("path"), ": ", c("text")))
        .when((c("kind") == "string") & (c("what") == "date") & ~iso_date(c("text")), says("invalid ISO date at ", c("path"), ": ", c("text")))
        .when((c("kind") == "number") & (F.isnan("number") | (F.abs("number") == float("inf"))), says("impossible number at ", c("path"), ": NaN/Infinity"))
        .when(c("kind").isin("integer", "number") & (c("what") == "minimum") & (c("bound") == 0) & (c("number") < 0), says("negative number at ", c("path"), " violates minimum 0"))
    )


def _first(found: DataFrame, candidates: list[tuple[Column, Column]]) -> DataFrame:
    """key and error: of all rows' messages (place, message) the one of the least place; null if there is none."""
    some = F.array_min(F.filter(F.array(*(F.when(said.isNotNull(), F.struct(place.alias("place"), said.alias("said"))) for place, said in candidates)), lambda x: x.isNotNull()))
    return found.select("key", some.alias("m")).groupBy("key").agg(F.min("m")["said"].alias("error"))


def schema_errors(df: DataFrame, key: str, raw: str, schema: dict[str, Any]) -> DataFrame:
    """key and error of every text: invalid JSON, or the first violation of the schema in the order of a walk (type, enum, required, properties as the schema lists them, others, items, bounds); null if there is none. key must tell rows apart."""
    found = _ruled(rows(df, key, raw), schema)
    return _first(found, [(F.array(F.lit(0)), F.col("error")), (F.concat(F.array(F.lit(1)), _place()), _violation("$"))]).withColumnRenamed("key", key)


def tool_call_errors(df: DataFrame, key: str, raw: str, schema: dict[str, Any] | None = None, allowed: tuple[str, ...] = ()) -> DataFrame:
    """key and error of every proposed call: its shape, the tools allowed, the arguments' schema, then the first unsafe value in the arguments' own order; null if there is none. Nothing is executed. key must tell rows apart."""
    found = _ruled(rows(df, key, raw, calls=True), schema or {})
    refused = F.when(~F.col("tool").isin(*allowed), F.concat(F.lit("disallowed tool: "), "tool")) if allowed else F.lit(None).cast("string")
    says = [
        (F.array(F.lit(0)), F.col("error")), (F.array(F.lit(1)), refused), (F.concat(F.array(F.lit(2)), _place()), F.concat(F.lit("schema violation: "), _violation("$.arguments"))),
        (F.array(F.lit(3), F.col("pos")), _unsafe()),
    ]
    return _first(found, says).withColumnRenamed("key", key)
