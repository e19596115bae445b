"""Prompts as Columns: a template is compiled on the driver, rows are rendered in the JVM."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from recordforge.functions.jsonx import schema_text

NAME = r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*"
TOKEN = re.compile(r"\{\{\s*(.*?)\s*\}\}|\{%-?\s*(.*?)\s*-?%\}", re.S)
#: Closing block of every prompt; {n} and {schema} are filled in.
CLOSING = "\nReturn exactly {n} records as JSON of this form:\n{schema}"
LIST_CLOSING = "\nThe list {name} has exactly {n} elements. Return a JSON array of exactly {n} results, in the same order, of this form:\n{schema}"
#: Headers and footers by name.
PRESETS = {"data_gen": ("You write records of synthetic data.", "Be varied and precise."), "eval": ("You judge records.", "Judge each record alone.")}

#: Whole templates by name. Their variables: user_instruction; optional topic and good, bad and duplicate examples.
COMPLETE = {
    "data_gen": "You write records of synthetic data.\nTask: {{ user_instruction }}"
    "{% if topic %}\nKeep to the topic {{ topic }}.{% endif %}"
    "{% if good_examples %}\nRecords should be as good as these: {{ good_examples }}{% endif %}"
    "{% if bad_examples %}\nThey must not have the faults of these: {{ bad_examples }}{% endif %}"
    "{% if duplicate_examples %}\nThese are taken, so write others: {{ duplicate_examples }}{% endif %}"
    "\nLet no two records be alike."
}


def complete_preset(name: str) -> str:
    """A whole template, for `render_prompt`."""
    if name not in COMPLETE:
        raise ValueError(f"unknown complete preset {name!r}; use one of {sorted(COMPLETE)}")
    return COMPLETE[name]


def double_braces(template: str) -> str:
    """`{name}` becomes `{{ name }}`; doubled braces, blocks and JSON literals stay."""
    return re.sub(rf"(?<![{{%]){{({NAME})}}(?!}})", r"{{ \1 }}", template)


def variables(template: str) -> tuple[set[str], set[str]]:
    """(required, optional): names in conditions, or only used within a condition's branches, are optional."""
    required, optional, depth = set(), set(), 0
    for value, block in TOKEN.findall(double_braces(template)):
        if value:
            (optional if depth else required).add(value.split(".")[0])
        elif block.startswith("if"):
            optional.update(n.split(".")[0] for n in re.findall(NAME, block[2:]) if n not in ("and", "or", "not", "is"))
            depth += 1
        elif block.startswith("endif"):
            depth -= 1
    return required, optional - required


def with_preset(template: str, preset: str | None) -> str:
    if preset is None:
        return template
    if preset not in PRESETS:
        raise ValueError(f"unknown preset {preset!r}; use one of {sorted(PRESETS)}")
    header, footer = PRESETS[preset]
    return f"{header}\n{template}\n{footer}"


def _parse(tokens: list[tuple[str, str]], ends: tuple[str, ...]) -> tuple[list, str]:
    body: list = []
    while tokens:
        kind, value = tokens.pop(0)
        if kind != "block":
            body.append((kind, value))
        elif value in ends:
            return body, value
        elif value.startswith("if "):
            name, negate = re.fullmatch(rf"if\s+(not\s+)?({NAME})", value), False
            if not name:
                raise ValueError(f"unsupported condition {value!r}")
            negate = bool(name[1])
            yes, end = _parse(tokens, ("else", "endif"))
            no = _parse(tokens, ("endif",))[0] if end == "else" else []
            body.append(("if", (name[2], negate, yes, no)))
        else:
            raise ValueError(f"unsupported block {value!r}")
    if ends:
        raise ValueError(f"missing {' or '.join(ends)}")
    return body, ""


def compile_template(template: str, types: Mapping[str, str]) -> Column:
    """The text of a template as one Column over columns of the given types.

    Supports variables, dotted names and if / if not / else. A null variable is
    an empty text, a list or struct its JSON; a condition holds for a value that
    is not null, empty, zero or false.
    """
    text, tokens, at = double_braces(template), [], 0

    def as_text(name: str) -> Column:
        nested = types[name.split(".")[0]].startswith(("array", "map", "struct")) and "." not in name
        return F.to_json(F.col(name)) if nested else F.col(name).cast("string")

    for m in TOKEN.finditer(text):
        tokens.append(("text", text[at : m.start()]))
        if m[1] is not None:
            if not re.fullmatch(NAME, m[1]):
                raise ValueError(f"unsupported expression {m[1]!r}")
            tokens.append(("value", m[1]))
        else:
            tokens.append(("block", m[2]))
        at = m.end()
    tokens.append(("text", text[at:]))

    def build(body: list) -> Column:
        parts = []
        for kind, value in body:
            if kind == "text":
                parts += [F.lit(value)] if value else []
            elif kind == "value":
                known = value.split(".")[0] in types
                parts.append(F.coalesce(as_text(value), F.lit("")) if known else F.lit(""))
            else:
                name, negate, yes, no = value
                truth = F.lit(False)
                if name.split(".")[0] in types:
                    c = F.col(name)
                    truth = F.coalesce(c if types[name.split(".")[0]] == "boolean" else ~as_text(name).isin("", "0", "0.0", "false", "[]", "{}"), F.lit(False))
                parts.append(F.when(~truth if negate else truth, build(yes)).otherwise(build(no)))
        return F.concat(*parts) if parts else F.lit("")

    return build(_parse(tokens, ())[0])


def _schema(schema: str | dict | Sequence[dict]) -> str:
    return schema if isinstance(schema, str) else schema_text(schema)


def render_prompt(df, template: str, schema: str | dict | Sequence[dict] = "{}", preset: str | None = None, num_records: int | str = 1):
    """Adds prompt and prompt_error (null where every required variable has a value).

    A required variable that is no column is an error; one that is null fails its row.
    schema: what the prompt says of the JSON that it wants, as it stands, or a field list or JSON schema to describe.
    """
    full = with_preset(template, preset)
    required, _ = variables(full)
    if missing := required - set(df.columns):
        raise ValueError(f"missing required variables: {sorted(missing)}")
    n = F.col(num_records).cast("string") if isinstance(num_records, str) else F.lit(str(num_records))
    before, after = (part.replace("{schema}", _schema(schema)) for part in CLOSING.split("{n}"))
    text = F.concat(compile_template(full, dict(df.dtypes)), F.lit(before), F.coalesce(n, F.lit("1")), F.lit(after))
    return _finish(df, text, required)


def render_list_prompt(df, template: str, list_col: str, schema: str | dict | Sequence[dict] = "{}"):
    """The same with a list variable: it becomes tagged JSON, and as many results are asked for."""
    required, _ = variables(template)
    if missing := required - set(df.columns):
        raise ValueError(f"missing required variables: {sorted(missing)}")
    tagged = F.concat(F.lit(f"<{list_col}>"), F.to_json(list_col), F.lit(f"</{list_col}>"))
    n = F.size(list_col).cast("string")
    before, middle, after = (part.replace("{name}", list_col).replace("{schema}", _schema(schema)) for part in LIST_CLOSING.split("{n}"))
    inner = df.withColumn("_list", F.col(list_col)).withColumn(list_col, tagged)
    body = compile_template(template, dict(inner.dtypes))
    out = inner.withColumn("_body", body).withColumn(list_col, F.col("_list"))
    return _finish(out, F.concat(F.col("_body"), F.lit(before), n, F.lit(middle), n, F.lit(after)), required).drop("_body", "_list")


def _finish(df, text: Column, required: Sequence[str]):
    error = F.lit(None).cast("string")
    for name in sorted(required, reverse=True):
        error = F.when(F.col(name).isNull(), f"missing required variable: {name}").otherwise(error)
    return df.withColumn("prompt_error", error).withColumn("prompt", F.when(F.col("prompt_error").isNull(), text))


def chat_messages(user: Column, system: Column | None = None) -> Column:
    """[{system}?, {user}]"""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    first = F.when(system != "", message("system", system)) if system is not None else F.lit(None).cast("struct<role:string,content:string>")
    return F.array_compact(F.array(first, message("user", user)))
