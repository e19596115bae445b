"""JSON in model replies: find it, repair it, unwrap it, validate it.

Most rows take the built-in lane (`try_parse_json`); only those that it cannot
parse go through the vectorised helper.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Field types of user schemas: the Spark type of each.
FIELD_TYPES = {"str": "string", "int": "bigint", "float": "double", "bool": "boolean", "null": "string"}
#: Type names of JSON schemas and of API contracts, as prefixes of schema_of_variant.
VARIANT_PREFIXES = {
    "string": ("STRING",), "str": ("STRING",), "integer": ("BIGINT", "BOOLEAN"), "int": ("BIGINT", "BOOLEAN"), "number": ("BIGINT", "DECIMAL", "DOUBLE", "BOOLEAN"),
    "float": ("BIGINT", "DECIMAL", "DOUBLE", "BOOLEAN"), "boolean": ("BOOLEAN",), "bool": ("BOOLEAN",), "array": ("ARRAY",), "list": ("ARRAY",), "object": ("OBJECT",), "dict": ("OBJECT",), "null": ("VOID",),
}


OPENING = re.compile(r"[{\[]")
#: What changes the nesting: whole strings, brackets, and a quote that no other one ends.
NESTING = re.compile(r'"(?:[^"\\]|\\.)*+"|["{}\[\]]', re.S)
BRACKETS = re.compile(r"[{}\[\]]")
CLOSES = {"{": "}", "[": "]"}


def balanced(text: str) -> str | None:
    """The first {..} or [..] that closes, else the first one within such as never do.

    One pass with a stack of the open brackets and their places. Brackets in
    strings do not count, nor does a closing bracket of the wrong kind. A quote
    that is never ended is a plain character, and so are all that follow it.
    """
    first = OPENING.search(text)
    if not first:
        return None
    opened: list[tuple[str, int]] = []
    inner: tuple[int, int] | None = None
    at, tokens = first.start(), NESTING
    while m := tokens.search(text, at):
        at, c = m.end(), m[0]
        if c == '"':
            if inner:
                break
            opened.clear()
            tokens = BRACKETS
        elif c in CLOSES:
            opened.append((c, m.start()))
        elif opened and CLOSES[opened[-1][0]] == c:
            start = opened.pop()[1]
            if not opened:
                return text[start:at]
            if inner is None or start < inner[0]:
                inner = (start, at)
    return text[slice(*inner)] if inner else None


@F.pandas_udf(T.StringType())
def _balanced(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else balanced(t))


#: Fenced blocks: one tagged json; any, whose first line is a tag unless a value begins there.
TAGGED = r"(?s)```json(.*?)```"
FENCED = r"(?s)```(?:(?!\s*[{\[])[^\n`]*\n)?(.*?)```"


def extract_json(text: Column) -> Column:
    """The JSON text of a reply, or null: a fence tagged json, any fence, a balanced value.

    Rows with a fence stay in the JVM.
    """
    inside = lambda pattern: F.regexp_replace(F.regexp_extract(text, pattern, 1), r"^\s+|\s+$", "")
    fenced = text.rlike(FENCED) | text.rlike(TAGGED)
    return F.when(text.rlike(TAGGED), inside(TAGGED)).when(fenced, inside(FENCED)).otherwise(_balanced(F.when(~fenced, text)))


def extract_json_loose(text: Column) -> Column:
    """The whole text if it is an object or list, else a fence, else from the first bracket to the last of its kind; null unless it parses."""
    whole = F.regexp_replace(text, r"^\s+|\s+$", "")
    fence = F.regexp_extract(whole, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    widest = F.regexp_extract(whole, r"(?s)(\{.*\}|\[.*\])", 1)
    pick = lambda c: F.when(F.try_parse_json(c).isNotNull(), c)
    return F.coalesce(F.when(whole.rlike(r"(?s)^(\{.*\}|\[.*\])$"), pick(whole)), pick(fence), pick(widest))


STRING = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"', re.S)
#: Control characters with an escape of their own.
ESCAPES = {"\t": "\\t", "\n": "\\n", "\r": "\\r"}


def _escaped(text: str) -> str:
    return STRING.sub(lambda m: '"' + m[0][1:-1].replace("\\", "\\\\") + '"', text)


def _without_controls(text: str) -> str:
    return STRING.sub(lambda m: "".join(ESCAPES.get(c, "" if c < " " else c) for c in m[0]), text)


def _finite(text: str) -> float | None:
    x = float(text)
    return x if math.isfinite(x) else None


def mend_json(text: str | None) -> str | None:
    """Valid JSON for a reply's JSON part, or null.

    Tried in turn: as it stands; backslashes in strings doubled; control
    characters in strings escaped or dropped; both. Of repeated keys the last
    counts; numbers that JSON cannot hold (NaN, infinities) become null.
    """
    if text is None:
        return None
    for repaired in (lambda t: t, _escaped, _without_controls, lambda t: _without_controls(_escaped(t))):
        try:
            return json.dumps(json.loads(repaired(text), parse_constant=lambda _: None, parse_float=_finite))
        except (ValueError, RecursionError):
            continue
    return None


@F.pandas_udf(T.StringType())
def _mend_json(text: pd.Series) -> pd.Series:
    return text.map(mend_json)


def repair_json(text: Column) -> Column:
    """JSON text that parses, or null; only texts that the built-in parser rejects leave the JVM."""
    fine = F.try_parse_json(text).isNotNull()
    return F.when(fine, text).otherwise(_mend_json(F.when(~fine, text)))


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def unwrap_json(v: Column, wrapper: str | None = None) -> Column:
    """An array of variants: the wrapper key's value if given; an object is a list of one; anything else is null."""
    inner = F.try_variant_get(v, f"$.{wrapper}", "variant") if wrapper else v
    return F.when(_kind(inner).startswith("ARRAY"), F.try_variant_get(inner, "$", "array<variant>")).when(_kind(inner).startswith("OBJECT"), F.array(inner))


def struct_of(fields: Sequence[dict]) -> T.StructType:
    """The Spark type of a field list: name, type, and items or properties."""

    def one(f: dict) -> T.DataType:
        kind = f.get("type")
        if kind in FIELD_TYPES:
            return T.StructType.fromDDL(f"x {FIELD_TYPES[kind]}")[0].dataType
        if kind == "list":
            return T.ArrayType(one(f["items"]) if f.get("items") else T.VariantType())
        if kind == "dict":
            return struct_of(f["properties"]) if f.get("properties") else T.VariantType()
        raise ValueError(f"unknown field type {kind!r}")

    for f in fields:
        if not f.get("name"):
            raise ValueError("a field has no name")
    return T.StructType([T.StructField(f["name"], one(f)) for f in fields])


def resolved(schema: dict, part: dict, within: tuple) -> tuple[dict | None, tuple]:
    """A part of a JSON schema behind its references and optional forms, and the references on the way; None in a cycle."""
    described = {k: part[k] for k in ("description", "default") if k in part}
    while "$ref" in part or "anyOf" in part:
        if "anyOf" in part:
            part = next((x for x in part["anyOf"] if x.get("type") != "null"), {})
            continue
        if part["$ref"] in within:
            return None, within
        within = (*within, part["$ref"])
        found: dict = schema
        for step in part["$ref"].removeprefix("#").strip("/").split("/"):
            found = found.get(step, {}) if step else found
        part = found
    return {**part, **described}, within


def json_schema_of(fields: Sequence[dict]) -> dict:
    """A field list as a JSON schema object."""
    kinds = {"str": "string", "int": "integer", "float": "number", "bool": "boolean", "list": "array", "dict": "object", "null": "null"}

    def one(f: dict) -> dict:
        out = {"type": kinds[f["type"]]} | ({"description": f["description"]} if f.get("description") else {})
        if f["type"] == "dict" and f.get("properties"):
            out |= json_schema_of(f["properties"])
        if f["type"] == "list" and f.get("items"):
            out["items"] = one(f["items"])
        return out

    if any(not f.get("name") or f.get("type") not in kinds for f in fields):
        raise ValueError("a field needs a name and one of the types " + ", ".join(kinds))
    return {"type": "object", "properties": {f["name"]: one(f) for f in fields}, "required": [f["name"] for f in fields if f.get("required", True)]}


#: What stands for a value of each type in the schema text; other types are empty objects.
SAMPLES = {"string": '""', "integer": "number", "number": "number", "boolean": "true or false", "array": "[]"}


def schema_text(schema: dict | Sequence[dict], wrapper: str | None = None, shown: int = 1) -> str:
    """What a prompt says of the JSON that it wants, from a field list or a JSON schema.

    A list of `shown` sample objects (under the key `wrapper`, if given), in which every field has a sample
    value and a comment: its description and whether it is required. References are
    followed; a type that holds itself is shown once.
    """
    schema = schema if isinstance(schema, dict) else json_schema_of(schema)

    def fields(s: dict, depth: int, within: tuple) -> list[str]:
        """The fields of an object, one under the other, with commas between them."""
        blocks = [value(f'"{name}": ', part, name in s.get("required", ()), depth, within) for name, part in s.get("properties", {}).items()]
        return [line + ("," if last and i < len(blocks) - 1 else "") for i, block in enumerate(blocks) for line, last in zip(block, [False] * (len(block) - 1) + [True])]

    def value(label: str, part: dict, required: bool, depth: int, within: tuple) -> list[str]:
        pad, whole = "  " * depth, part
        s, inside = resolved(schema, part, within)
        note = f"  // {(s or whole).get('description', '')} ({'required' if required else 'optional'})"
        if s is None:
            return [f"{pad}{label}{{}}{note}"]
        if s.get("type") == "object" and s.get("properties"):
            return [f"{pad}{label}{{{note}", *fields(s, depth + 1, inside), f"{pad}}}"]
        if s.get("type") == "array" and s.get("items"):
            item, deeper = resolved(schema, s["items"], inside)
            if item and item.get("properties"):
                body = [f"{pad}  {{", *fields(item, depth + 2, deeper), f"{pad}  }}", f"{pad}  // ... more items ..."]
            else:
                body = [f"{pad}  // Example items of type {(item or {}).get('type', 'object')}"]
            return [f"{pad}{label}[{note}", *body, f"{pad}]"]
        return [f"{pad}{label}{SAMPLES.get(s.get('type', 'string'), '{}')}{note}"]

    top, within = resolved(schema, schema, ())
    depth = 3 if wrapper else 2
    sample = ["    {", *fields(top or {}, depth, within), "    }"]
    samples = [line for i in range(shown) for line in ([*sample[:-1], "    },"] if i < shown - 1 else sample)]
    lines = ["{", f'  "{wrapper}": [', *samples, "    ...", "  ]", "}"] if wrapper else ["[", *samples, "    ...", "]"]
    about = [str(schema[k]) for k in ("title", "description") if schema.get(k)]
    needed = (top or {}).get("required") or []
    return "\n".join([*lines, *([""] + about if about else []), *([f"\nRequired fields: {', '.join(needed)}"] if needed else [])])


def struct_of_json_schema(schema: dict) -> T.StructType:
    """The Spark type of a JSON schema object; $ref, $defs and anyOf-with-null are resolved.

    A type that holds itself is a variant from there on.
    """

    def one(s: dict, within: tuple = ()) -> T.DataType:
        s, within = resolved(schema, s, within)
        if s is None:
            return T.VariantType()
        kind = s.get("type")
        if kind == "array":
            return T.ArrayType(one(s["items"], within) if s.get("items") else T.VariantType())
        if kind == "object":
            if s.get("properties"):
                return T.StructType([T.StructField(k, one(x, within)) for k, x in s["properties"].items()])
            return T.MapType(T.StringType(), one(s["additionalProperties"], within)) if isinstance(s.get("additionalProperties"), dict) else T.VariantType()
        simple = {"string": T.StringType(), "integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType(), "null": T.StringType()}
        return simple.get(kind, T.VariantType())

    out = one(schema)
    if not isinstance(out, T.StructType):
        raise ValueError("the schema is no object with properties")
    return out


def _keys(v: Column) -> Column:
    return F.coalesce(F.json_object_keys(F.to_json(v)), F.array().cast("array<string>"))


def _kept(errors: list[Column]) -> Column:
    return F.array_compact(F.array(*errors))


def item_errors(v: Column, fields: Sequence[dict], type_check: bool = False, strict_bool: bool = False) -> Column:
    """Errors of one item: missing required fields, unexpected ones, and with `type_check` nulls and wrong types, nested ones too.

    Booleans pass as numbers unless `strict_bool`.
    """
    required = [f["name"] for f in fields if f.get("required", True)]
    names = [f["name"] for f in fields]
    keys = _keys(v)
    said = lambda label, found: F.when(F.size(found) > 0, F.concat(F.lit(label), F.array_join(F.array_sort(found), ", ")))
    texts = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    errors = [said("missing: ", F.array_except(texts(required), keys)), said("unexpected: ", F.array_except(keys, texts(names)))]
    out = _kept(errors)
    for f in fields if type_check else ():
        got = F.try_variant_get(v, f"$.{f['name']}", "variant")
        kind = _kind(got)
        right = F.lit(False)
        for prefix in VARIANT_PREFIXES[f["type"]]:
            if not (strict_bool and prefix == "BOOLEAN" and f["type"] != "bool"):
                right = right | kind.startswith(prefix)
        there = F.array_contains(keys, f["name"])
        out = F.concat(out, _kept([F.when(there & (kind == "VOID") & F.lit(f["type"] != "null"), F.lit(f"null: {f['name']}")).when(there & ~right, F.concat(F.lit(f"type: {f['name']} is "), F.lower(F.regexp_extract(kind, "^[A-Z]+", 0))))]))
        if f["type"] == "dict" and f.get("properties"):
            out = F.concat(out, F.when(kind.startswith("OBJECT"), item_errors(got, f["properties"], True, strict_bool)).otherwise(F.array().cast("array<string>")))
        if f["type"] == "list" and (f.get("items") or {}).get("properties"):
            inner = F.try_variant_get(got, "$", "array<variant>")
            out = F.concat(out, F.coalesce(F.flatten(F.transform(inner, lambda x: item_errors(x, f["items"]["properties"], True, strict_bool))), F.array().cast("array<string>")))  # noqa: B023
    return F.when(_kind(v).startswith("OBJECT"), out).otherwise(F.array(F.lit("no object")))


def validate_items(items: Column, fields: Sequence[dict], type_check: bool = False, strict_bool: bool = False) -> Column:
    """Errors of all items of an array of variants, each with its position."""
    return F.flatten(F.transform(items, lambda v, i: F.transform(item_errors(v, fields, type_check, strict_bool), lambda e: F.concat(i.cast("string"), F.lit(": "), e))))


def parse_replies(df: DataFrame, reply: str, fields: Sequence[dict], wrapper: str | None = None, strict: bool = False, type_check: bool = False) -> DataFrame:
    """Adds data (array of variants), parse_status (ok or failed) and parse_error.

    Strict: a bad reply raises when it is read. Otherwise its data is null.
    """
    found = df.withColumn("_found", extract_json(F.col(reply)))
    mended = found.withColumn("_json", F.try_parse_json(repair_json(F.col("_found"))))
    items = mended.withColumn("_items", unwrap_json(F.col("_json"), wrapper))
    wrong = items.withColumn("_errors", validate_items(F.col("_items"), fields, type_check))
    why = F.when(F.col("_found").isNull(), "no JSON found").when(F.col("_json").isNull(), "JSON does not parse").when(F.col("_items").isNull(), "no object or list").when(F.size("_errors") > 0, F.array_join("_errors", "; "))
    out = wrong.withColumn("parse_error", why)
    data = F.when(F.col("parse_error").isNull(), F.col("_items"))
    if strict:
        data = F.when(F.col("parse_error").isNotNull(), F.raise_error(F.concat(F.lit("reply: "), F.col("parse_error"))).cast("array<variant>")).otherwise(data)
    return out.withColumns({"data": data, "parse_status": F.when(F.col("parse_error").isNull(), "ok").otherwise("failed")}).drop("_found", "_json", "_items", "_errors")


def parse_typed(df: DataFrame, reply: str, struct: T.StructType, required: Sequence[str] = (), wrapper: str | None = None) -> DataFrame:
    """Adds typed (array of the struct, null for a bad reply) and parse_error."""
    items = df.withColumn("_items", unwrap_json(F.try_parse_json(repair_json(extract_json(F.col(reply)))), wrapper))
    typed = items.withColumn("typed", F.from_json(F.to_json(F.col("_items")), T.ArrayType(struct)))
    absent = [F.when(F.exists("typed", lambda x: x[name].isNull()), F.lit(name)) for name in required]  # noqa: B023
    lacking = F.array_join(F.array_compact(F.array(F.lit(None).cast("string"), *absent)), ", ")
    why = F.when(F.col("_items").isNull(), "no object or list").when(lacking != "", F.concat(F.lit("missing: "), lacking))
    out = typed.withColumn("parse_error", why)
    return out.withColumn("typed", F.when(F.col("parse_error").isNull(), F.col("typed"))).drop("_items")


def missing_params(given: Column, required: Sequence[str], known: Sequence[str]) -> dict[str, Column]:
    """Required names that are not given, given names that are not known; sorted."""
    texts = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    return {"missing": F.array_sort(F.array_except(texts(required), given)), "unknown": F.array_sort(F.array_except(given, texts(known)))}


def call_errors(call: Column, contract: dict) -> Column:
    """Reasons why a function call does not fit its contract: the first failed structure rule, or all wrong types."""
    params = contract["parameters"]
    required = [p for p, d in params.items() if d.get("required", True)]
    keys = _keys(call)
    arguments = F.try_variant_get(call, "$.arguments", "variant")
    given = _keys(arguments)
    names = missing_params(given, required, list(params))
    rule = (
        F.when(~_kind(call).startswith("OBJECT"), F.lit("call is no object"))
        .when(~(F.array_contains(keys, "name") & F.array_contains(keys, "arguments")), F.lit("call needs name and arguments"))
        .when(~_kind(arguments).startswith("OBJECT"), F.lit("arguments is no object"))
        .when(F.trim(F.coalesce(F.try_variant_get(call, "$.name", "string"), F.lit(""))) != contract["name"].strip(), F.lit("name differs from the contract"))
        .when(F.size(names["missing"]) > 0, F.concat(F.lit("missing parameters: "), F.array_join(names["missing"], ", ")))
        .when(F.size(names["unknown"]) > 0, F.concat(F.lit("unknown parameters: "), F.array_join(names["unknown"], ", ")))
    )
    types = []
    for p, d in params.items():
        prefixes = VARIANT_PREFIXES.get(d["type"].lower())
        if prefixes:
            kind = _kind(F.try_variant_get(arguments, f"$.{p}", "variant"))
            right = F.lit(False)
            for prefix in prefixes:
                right = right | kind.startswith(prefix)
            types.append(F.when(F.array_contains(given, p) & ~right, F.lit(f"{p} should be {d['type'].lower()}")))
    return F.when(rule.isNotNull(), F.array(rule)).otherwise(_kept([*types, F.lit(None).cast("string")]))


def check_calls(df: DataFrame, query: str, answer: str, contract: dict) -> DataFrame:
    """Adds format_ok, needs_model and reasons for the JSON answer to a query.

    An empty query or answer passes the format and needs no model, and so does
    not pass; an answer that is a plain text is left to the model.
    """
    parsed = F.try_parse_json(F.col(answer))
    empty = (F.coalesce(F.col(query), F.lit("")) == "") | (F.coalesce(F.col(answer), F.lit("")) == "") | (F.size(F.coalesce(unwrap_json(parsed), F.array(parsed))) == 0)
    errors = F.coalesce(F.flatten(F.transform(unwrap_json(parsed), lambda c: call_errors(c, contract))), F.array().cast("array<string>"))
    out = df.withColumn("reasons", F.when(empty, F.array().cast("array<string>")).otherwise(errors))
    return out.withColumns({"format_ok": F.size("reasons") == 0, "needs_model": ~empty & (F.size("reasons") == 0)})
