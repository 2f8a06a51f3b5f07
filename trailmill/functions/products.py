"""Product comparisons: pass, fail or unverifiable, as column expressions over normal text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scores import tri_state
from .text import nfkc_casefold

# Prefixes that negate what follows; a model token is 2 to 24 characters with a digit, letters or digits on its edges.
NEGATIONS = ("不支持", "不含", "不具备", "没有", "无", "非", "不")
MODEL_TOKEN = r"(?<![a-z0-9])(?=[a-z0-9._+-]{2,24}(?![a-z0-9]))(?=[a-z0-9._+-]*[0-9])[a-z0-9._+-]+"


def squeezed(x: Column) -> Column:
    """STR1: folded text without any white space."""
    return F.regexp_replace(F.coalesce(nfkc_casefold(x.cast("string")), F.lit("")), r"(?U)\s+", "")


def spaced(x: Column) -> Column:
    """STR1: folded text with single spaces."""
    return F.regexp_replace(F.coalesce(nfkc_casefold(x.cast("string")), F.lit("")), r"(?U)\s+", " ")


def canonical_brand(normal: Column, aliases: dict[str, list[str]]) -> Column:
    """STR7: the canonical name of a normal brand text; names without an alias stand for themselves."""
    table = {a: name for name, others in aliases.items() for a in (name, *others)}
    if not table:
        return normal
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[normal], normal)


def brand(required: Column, actual: Column, aliases: dict[str, list[str]]) -> Column:
    """RWD1: whether any required brand (normal texts) is the actual one, aliases counted as their name."""
    wanted = F.filter(F.coalesce(required, F.array().cast("array<string>")), lambda v: v != "")
    hit = F.exists(wanted, lambda v: canonical_brand(v, aliases) == canonical_brand(actual, aliases))
    return tri_state((F.size(wanted) > 0) & (F.coalesce(actual, F.lit("")) != ""), hit)


def brand_gate(expected: Column, text: Column, aliases: dict[str, list[str]]) -> Column:
    """RWD17: an explicit brand passes if it, or any alias of its name with two characters or more, stands in the product's brand text."""
    name = canonical_brand(expected, aliases)
    table = [(a, n) for n, others in aliases.items() for a in (n, *others) if len(a) >= 2]
    hit = F.contains(text, expected)
    for alias, n in table:
        hit = hit | (F.contains(text, F.lit(alias)) & (name == F.lit(n)))
    return F.when(F.coalesce(hit, F.lit(False)), "pass").otherwise("fail")


def model_tokens(text: Column) -> Column:
    """STR5: distinct model-like tokens of a normal text, in order; a longer run counts if a cut of 2 to 24 characters ends at a mark."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({MODEL_TOKEN})"), 1))


def model_match(needle: Column, haystack: Column) -> Column:
    """STR6: an ASCII model inside the text with no letter or digit beside it, any other one equal to the whole text."""
    ascii_ = needle.rlike(r"^[a-z0-9._+-]+$")
    # without look-arounds for a pattern in a column: cut at the needle, and look at the characters beside each cut
    parts = F.split(haystack, F.concat(F.lit("\\Q"), needle, F.lit("\\E")), F.lit(-1))
    edge = lambda before, after: ~before.rlike("[a-z0-9]$") & ~after.rlike("^[a-z0-9]")
    pairs = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: edge(F.element_at(parts, i), F.element_at(parts, i + 1)))
    inside = (F.size(parts) > 1) & F.exists(F.when(F.size(parts) > 1, pairs), lambda x: x)
    return F.when((needle == "") | (haystack == ""), False).when(ascii_, F.coalesce(inside, F.lit(False))).otherwise(needle == haystack)


def model(required: Column, actual: Column) -> Column:
    """RWD1: whether all required models (normal texts) are in the actual text."""
    wanted = F.coalesce(required, F.array().cast("array<string>"))
    return tri_state(F.exists(wanted, lambda v: v != "") & (F.coalesce(actual, F.lit("")) != ""), F.forall(wanted, lambda v: model_match(v, actual)))


def category_path(x: Column) -> Column:
    """STR9: the parts of a category path, normal and without empty ones."""
    return F.filter(F.split(squeezed(x), "›"), lambda p: p != "")


def category_names(path: Column) -> Column:
    """STR9: struct of leaf, ancestors and top of a category path."""
    n = F.size(path)
    return F.struct(F.try_element_at(path, F.lit(-1)).alias("leaf"), F.slice(path, F.lit(1), F.greatest(n - 1, F.lit(0))).alias("ancestors"), F.try_element_at(path, F.lit(1)).alias("top"))


def category(required: Column, actual: Column) -> Column:
    """RWD1: same leaf and, where both have ancestors, a common one. Arguments are category_path() arrays."""
    a, b = category_names(required), category_names(actual)
    kin = (F.size(a["ancestors"]) == 0) | (F.size(b["ancestors"]) == 0) | F.arrays_overlap(a["ancestors"], b["ancestors"])
    return tri_state((F.size(required) > 0) & (F.size(actual) > 0), (a["leaf"] == b["leaf"]) & kin)


def occurrence(text: Column, expected: Column) -> Column:
    """STR12: true if the value stands in the text without a negation right before it, null if only negated, false if absent."""
    parts = F.split(text, F.concat(F.lit("\\Q"), expected, F.lit("\\E")), F.lit(-1))
    heads = F.slice(parts, F.lit(1), F.size(parts) - 1)
    negated = f"({'|'.join(NEGATIONS)})$"
    return F.when((expected == "") | (F.size(parts) <= 1), False).when(F.exists(heads, lambda h: ~h.rlike(negated)), True)


def core_functions(required: Column, attributes: Column, fallback: Column) -> Column:
    """RWD1, JN13: every required function in an attribute, or else in the fallback text, and not only negated. Normal texts."""
    wanted = F.filter(F.coalesce(required, F.array().cast("array<string>")), lambda v: v != "")
    have, text = F.coalesce(attributes, F.array().cast("array<string>")), F.coalesce(fallback, F.lit(""))

    def met(v: Column) -> Column:
        seen = F.transform(F.filter(have, lambda a: F.contains(a, v)), lambda a: occurrence(a, v))
        structured = F.when(F.exists(seen, lambda s: s.eqNullSafe(F.lit(True))), True).when(F.size(seen) > 0, False)
        return F.coalesce(structured, occurrence(text, v), F.lit(False))

    return tri_state((F.size(wanted) > 0) & ((F.size(have) > 0) | (text != "")), F.forall(wanted, met))


def required_options(required: Column, axes: Column, selected: Column) -> Column:
    """RWD2: struct of status and the axes that are missing, unavailable or wrong.

    required and selected: map axis -> value; axes: map axis -> array of values the product offers. Normal texts, canonical axes.
    """
    keys = F.array_sort(F.map_keys(required))
    missing = F.filter(keys, lambda k: axes[k].isNull())
    offered = F.filter(keys, lambda k: axes[k].isNotNull())
    unavailable = F.filter(offered, lambda k: ~F.array_contains(axes[k], required[k]))
    wrong = F.filter(offered, lambda k: F.array_contains(axes[k], required[k]) & ~selected[k].eqNullSafe(required[k]))
    status = F.when(required.isNull() | (F.size(missing) > 0), "unverifiable").when((F.size(unavailable) > 0) | (F.size(wrong) > 0), "fail").otherwise("pass")
    return F.struct(status.alias("status"), missing.alias("missing"), unavailable.alias("unavailable"), wrong.alias("wrong"))


def option_axis(value: Column, axes: Column) -> Column:
    """JN14: struct of the only axis whose values hold the value, or why there is none: axis_not_found, axis_ambiguous."""
    hits = F.array_sort(F.filter(F.map_keys(axes), lambda k: F.array_contains(axes[k], value)))
    return F.struct(F.when(F.size(hits) == 1, hits[0]).alias("axis"), F.when(F.size(hits) == 0, "axis_not_found").when(F.size(hits) > 1, "axis_ambiguous").alias("reason"))


def price_gate(price: Column, resolved: Column, upper: Column) -> Column:
    """RWD17: no budget passes; an unresolved or senseless price or limit is unverifiable."""
    good = F.coalesce((resolved == "pass") & (price >= 0) & (upper > 0) & (F.abs(price) < float("inf")) & (F.abs(upper) < float("inf")), F.lit(False))
    return F.when(upper.isNull(), "pass").otherwise(tri_state(good, price <= upper))
