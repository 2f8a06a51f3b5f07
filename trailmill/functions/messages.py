"""Assistant turns, tool arguments, JSON text and instructions as column expressions."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .options import bound

#: Messages the functions read: role, content, and calls with a function's name and its arguments as JSON text.
MESSAGES = "array<struct<role:string,content:string,tool_calls:array<struct<function:struct<name:string,arguments:string>>>>>"

# The mark before an instruction and what ends its block.
INSTRUCTION, BLOCK_ENDS = "Instruction:", ["\n\n【初始", "\n[SHOPPING_OBSERVATION_V2]"]


def json_kind(value: Column) -> Column:
    """Type of a variant: object, array, string, integer, number, boolean or null. A whole decimal such as 1.0 may be an integer."""
    return bound(F.schema_of_variant(value), _kind)


def _kind(s: Column) -> Column:
    return (
        F.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean")
        .when((s == "BIGINT") | s.rlike(r"^DECIMAL\([0-9]+,0\)$"), "integer").when(s.startswith("DECIMAL") | s.isin("DOUBLE", "FLOAT"), "number").otherwise("null")
    )


def accepts(value: Column, schema: dict) -> Column:
    """FLT10: whether a variant fits a schema: type, required, additionalProperties, properties in depth, enum."""
    return bound(value, lambda v: _accepts(v, schema))


def _accepts(value: Column, schema: dict) -> Column:
    kind, wanted = json_kind(value), schema.get("type")
    if wanted == "object":
        children = {n: c for n, c in schema.get("properties", {}).items() if isinstance(c, dict)}
        keys = F.json_object_keys(F.to_json(value))
        ok = F.lit(True)
        for name in schema.get("required", []):
            ok = ok & F.array_contains(keys, name)
        if schema.get("additionalProperties") is False:
            ok = ok & F.forall(keys, lambda k: k.isin(list(schema.get("properties", {}))))
        for name, child in children.items():
            inner = F.try_variant_get(value, f"$['{name}']", "variant")
            ok = ok & (~F.array_contains(keys, name) | accepts(inner, child))
        return F.when(kind == "object", F.coalesce(ok, F.lit(False))).otherwise(False)
    ok = F.lit(True)
    if wanted in ("string", "integer", "boolean", "array"):
        ok = kind == wanted
    elif wanted == "number":
        ok = kind.isin("integer", "number")
    if isinstance(schema.get("enum"), list):
        ok = ok & F.to_json(value).isin([json.dumps(v, ensure_ascii=False) for v in schema["enum"]])
    return F.coalesce(ok, F.lit(False))


def first_format_error(messages: Column, truncations: Column, schemas: dict[str, dict]) -> Column:
    """FLT9: struct of the first assistant turn in error and its reason, null where all turns are well formed.

    schemas: the parameters of every known tool. A null arguments text counts as no arguments. Without an assistant
    turn the call is missing; calls that were cut off count as several, once all turns are well formed.
    """

    def reason(m: Column) -> Column:
        return bound(F.get(m["tool_calls"], F.lit(0))["function"], lambda f: bound(F.try_parse_json(F.coalesce(f["arguments"], F.lit("{}"))), lambda parsed: checked(m, f, parsed)))

    def checked(m: Column, f: Column, parsed: Column) -> Column:
        fits = F.lit(False)
        for name, schema in schemas.items():
            fits = fits | ((f["name"] == name) & accepts(parsed, schema))
        return (
            F.when(F.coalesce(F.size(m["tool_calls"]), F.lit(0)) <= 0, "missing_tool_call").when(F.size(m["tool_calls"]) > 1, "multiple_tool_calls").when(f.isNull(), "malformed_arguments")
            .when(~F.coalesce(f["name"].isin(list(schemas)), F.lit(False)), "unknown_tool")
            .when(parsed.isNull() | (json_kind(parsed) != "object"), "malformed_arguments").when(~fits, "schema_invalid")
        )

    turns = F.filter(messages, lambda m: m["role"] == "assistant")
    found = F.filter(F.transform(turns, lambda m, i: F.struct(i.alias("turn"), reason(m).alias("reason"))), lambda r: r["reason"].isNotNull())
    at_start = lambda why: F.struct(F.lit(0).alias("turn"), F.lit(why).alias("reason"))
    return F.when(F.coalesce(F.size(turns), F.lit(0)) <= 0, at_start("missing_tool_call")).when(F.size(found) > 0, F.get(found, F.lit(0))).when(truncations > 0, at_start("multiple_tool_calls"))


def template_messages(messages: Column) -> Column:
    """ARR7: messages whose call arguments are objects (variants) in place of text; null if any arguments text is no object."""
    parsed = lambda c: F.try_parse_json(c["function"]["arguments"])
    bad = lambda c: c["function"]["arguments"].isNotNull() & (parsed(c).isNull() | (json_kind(parsed(c)) != "object"))
    call = lambda c: F.struct(F.struct(c["function"]["name"].alias("name"), parsed(c).alias("arguments")).alias("function"))
    shown = F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), F.transform(m["tool_calls"], call).alias("tool_calls")))
    return F.when(~F.exists(messages, lambda m: F.coalesce(F.exists(m["tool_calls"], bad), F.lit(False))), shown)


def nested(value: Column, *path: str, as_: str = "string") -> Column:
    """ARR4: what stands at a path of names in JSON text, null where any part is absent or of another type."""
    return F.try_variant_get(F.try_parse_json(value), "$" + "".join(f"['{p}']" for p in path), as_)


def _stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def instruction_block(content: Column) -> Column:
    """STR24: what follows the first instruction mark, up to the initial page; null without the mark or without text."""
    after = F.when(F.contains(content, F.lit(INSTRUCTION)), F.substr(content, F.instr(content, INSTRUCTION) + len(INSTRUCTION)))
    for end in BLOCK_ENDS:
        after = F.when(F.instr(after, end) > 0, F.substr(after, F.lit(1), F.instr(after, end) - 1)).otherwise(after)
    return F.nullif(_stripped(after), F.lit(""))


def instruction_of(initial: Column, messages: Column) -> Column:
    """STR24: the environment's instruction, else the first user message without its mark, else empty."""
    first = F.get(F.filter(messages, lambda m: m["role"] == "user"), F.lit(0))["content"]
    return F.coalesce(F.nullif(_stripped(initial), F.lit("")), F.regexp_replace(_stripped(first), r"(?i)^\s*Instruction:\s*", ""), F.lit(""))


@F.pandas_udf(T.StringType())
def canonical_json(x: pd.Series) -> pd.Series:
    """MTH6: JSON text with sorted keys and without spaces; null for what is no JSON."""

    def one(s: str | None) -> str | None:
        try:
            return None if s is None else json.dumps(json.loads(s), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    return x.map(one)


@F.pandas_udf(T.StringType())
def canonical_digest(x: pd.Series) -> pd.Series:
    """MTH6: sha256 of canonical JSON text."""
    return x.map(lambda s: None if s is None else hashlib.sha256(s.encode()).hexdigest())


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_leaves(x: pd.Series) -> pd.Series:
    """ARR2: texts of all values inside nested JSON, by sorted key and in array order; nulls and empty texts are left out.

    Text that is no JSON is its own leaf.
    """

    def one(s: str | None) -> list[str] | None:
        if s is None:
            return None
        try:
            waiting = [json.loads(s)]
        except ValueError:
            waiting = [s]
        out = []
        while waiting:
            v = waiting.pop()
            if isinstance(v, dict):
                waiting.extend(v[k] for k in sorted(v, reverse=True))
            elif isinstance(v, list):
                waiting.extend(reversed(v))
            elif v is not None and v != "":
                out.append(v if isinstance(v, str) else json.dumps(v))
        return out

    return x.map(one)
