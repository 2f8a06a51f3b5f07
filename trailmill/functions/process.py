"""Arrays of a trajectory: penalties located on steps, token islands, prefixes, padding, nested access."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEP = "struct<index:int,value:double,rule:string,kind:string>"


def penalties(steps: Column, f: dict[str, Column]) -> Column:
    """RWD8, JN10, WIN17: an array with a struct of value, rules and kind for each step.

    steps: array of struct (tool, value, progress_added, no_progress_steps). Fields: purchased, sampling_invalid,
    category_status, price_status, wrong_values and missing_axes (arrays). Of a step's events the most negative
    counts, the first of equals; its rules are listed once each. Values are normal texts.
    """
    n = F.size(steps)
    none = F.array().cast(f"array<{STEP}>")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    event = lambda index, value, rule, kind: F.struct(index.cast("int").alias("index"), F.lit(value).alias("value"), F.lit(rule).alias("rule"), F.lit(kind).alias("kind"))
    at = lambda i: F.get(steps, i)
    last = lambda test: F.array_max(F.filter(places, test))
    idle = F.filter(places, lambda i: at(i)["tool"].isin("search_products", "next_page") & (F.coalesce(F.size(at(i)["progress_added"]), F.lit(0)) <= 0) & (F.coalesce(at(i)["no_progress_steps"], F.lit(0)) >= 3))
    judged = F.coalesce(f["purchased"], F.lit(False)) & ~F.coalesce(f["sampling_invalid"], F.lit(False))
    buy = last(lambda i: at(i)["tool"] == "buy_now")
    wrong = F.array_distinct(F.filter(F.coalesce(f["wrong_values"], F.array().cast("array<string>")), lambda v: v != ""))
    chosen = F.filter(F.transform(wrong, lambda v: F.array_max(F.filter(places, lambda i: (at(i)["tool"] == "select_option") & (at(i)["value"] == v)))), lambda i: i.isNotNull())
    on_buy = lambda condition, value, rule, kind: F.when(judged & F.coalesce(condition, F.lit(False)) & buy.isNotNull(), F.array(event(buy, value, rule, kind))).otherwise(none)
    events = F.concat(
        F.transform(idle, lambda i: event(i, -0.25, "sustained_no_progress", "no_progress")),
        F.when(judged, F.transform(chosen, lambda i: event(i, -0.5, "wrong_option", "wrong_option"))).otherwise(none),
        on_buy(f["category_status"] == "fail", -1.0, "wrong_category_buy", "bad_buy"),
        on_buy(f["price_status"].isin("fail", "unverifiable"), -1.0, "invalid_price_buy", "bad_buy"),
        on_buy(F.size(F.coalesce(f["missing_axes"], F.array().cast("array<string>"))) > 0, -1.0, "missing_required_option_buy", "bad_buy"),
        on_buy((F.size(wrong) > 0) & (F.size(chosen) == 0), -0.5, "unlocated_wrong_option", "wrong_option"),
    )

    def of_step(i: Column) -> Column:
        own = F.filter(events, lambda e: e["index"] == i)
        least = F.array_min(F.transform(own, lambda e: e["value"]))
        first = F.get(F.filter(own, lambda e: e["value"] == least), F.lit(0))
        return F.struct(F.coalesce(least, F.lit(0.0)).alias("value"), F.array_distinct(F.transform(own, lambda e: e["rule"])).alias("rules"), F.coalesce(first["kind"], F.lit("normal")).alias("kind"))

    return F.transform(places, of_step)


def group_ends(mask: Column) -> Column:
    """WIN18: ends (exclusive) of the complete groups of ones and then zeros; a mask that begins with 0 has none."""
    n = F.size(mask)
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    ends = F.filter(places, lambda i: (F.element_at(mask, i) == 0) & ((i == n) | (F.get(mask, i) == 1)))
    return F.when((n > 0) & (F.get(mask, F.lit(0)) != 1), F.array().cast("array<int>")).otherwise(ends)


def common_prefix(a: Column, b: Column) -> Column:
    """WIN19: length of the longest common prefix of two arrays."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.eqNullSafe(y))
    differs = F.array_position(same, F.lit(False))
    return F.when(differs > 0, differs - 1).otherwise(n.cast("long"))


def padded(a: Column, length: Column, fill) -> Column:
    """PRJ17: the array filled up on the right."""
    return F.concat(a, F.array_repeat(F.lit(fill), F.greatest(length - F.size(a), F.lit(0)).cast("int")))


def request_tokens(usage: Column, context: Column) -> Column:
    """AG10: struct of source, prompt, completion and longest request, from the API's usage where there is any, else local counts.

    usage: array of struct (input, output, total), entries without input or output are none; context: array of input counts.
    """
    real = F.filter(F.coalesce(usage, F.array().cast("array<struct<input:bigint,output:bigint,total:bigint>>")), lambda u: u["input"].isNotNull() & u["output"].isNotNull())
    local = F.transform(F.coalesce(context, F.array().cast("array<bigint>")), lambda x: F.coalesce(x, F.lit(0)))
    add = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda s, x: s + x)
    some = F.size(real) > 0
    longest = F.array_max(F.transform(real, lambda u: F.coalesce(u["total"], u["input"] + u["output"])))
    return F.struct(
        F.when(some, "api_usage").when(F.size(local) > 0, "local_context_counter").otherwise("unavailable").alias("source"),
        F.when(some, add(F.transform(real, lambda u: u["input"]))).otherwise(add(local)).alias("prompt"),
        F.when(some, add(F.transform(real, lambda u: u["output"]))).otherwise(F.lit(0).cast("long")).alias("completion"),
        F.coalesce(F.when(some, longest).otherwise(F.array_max(local)), F.lit(0).cast("long")).alias("longest"),
    )


def call_action(name: Column, arguments: Column) -> Column:
    """STR18: `name[argument]` of a tool call: the name, and the values of its arguments in order of their names."""
    values = F.transform(F.array_sort(F.map_keys(arguments)), lambda k: arguments[k])
    return F.concat(name, F.lit("["), F.concat_ws(",", values), F.lit("]"))


def decoded_arguments(raw: Column) -> Column:
    """ARR6: struct of a tool call's arguments (map) and the error: missing, not_json, not_object."""
    parsed = F.from_json(raw, "map<string,string>")
    kind = F.json_object_keys(raw)
    value = F.try_parse_json(raw)
    error = F.when(F.coalesce(F.trim(raw), F.lit("")) == "", "missing").when(value.isNull(), "not_json").when(kind.isNull(), "not_object")
    return F.struct(F.when(error.isNull(), parsed).alias("arguments"), error.alias("error"))
