"""Option axes, variants, colours and sizes of products, and the purchase verifier, as column expressions over normal text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .products import squeezed
from .text import nfkc_casefold

# Canonical option axes and their aliases.
AXES = {
    "color": ["颜色", "颜色分类"],
    "size": ["尺码", "鞋码"],
    "dimensions": ["尺寸", "大小"],
    "net_content": ["净含量", "总净含量"],
    "flavor": ["口味", "食品口味"],
    "specification": ["规格", "规格描述", "规格类型"],
    "bundle": ["套餐", "套餐类型", "组合套餐"],
    "capacity": ["容量", "规格容量"],
}

# Shop name suffixes, the first that fits is cut.
SHOP_SUFFIXES = ["官方旗舰店", "旗舰店", "专卖店", "专营店", "企业店", "店"]

# Names that mean the same brand to the verifier.
SAME_TEXT = [["philips", "飞利浦"]]


def bound(x: Column, rule) -> Column:
    """rule(x) with x worked out once, however often the rule names it."""
    return F.get(F.transform(F.array(x), rule), F.lit(0))


def option_text(x: Column) -> Column:
    """STR10: folded option text without white space, `/` as `|`."""
    return F.translate(squeezed(x), "/", "|")


def canonical_axis(normal: Column, aliases: dict[str, list[str]] = AXES) -> Column:
    """STR10: the canonical axis of a normal axis name; a name without an alias stands for itself."""
    table = F.create_map(*[F.lit(x) for name, others in aliases.items() for a in others for x in (a, name)])
    return F.coalesce(F.try_element_at(table, normal), normal)


def axis_index(options: Column) -> Column:
    """ARR3: struct of axes and collisions (canonical names that several axes share; these axes are left out).

    options: array of struct (axis, values: array of struct (normal, value, price)), in the product's order, axis
    names normal. Of equal normal values the last counts, empty ones go; a price below zero or not finite is none.
    """

    def values(o: Column) -> Column:
        later = lambda v, i: F.exists(F.slice(o["values"], i + 2, F.size(o["values"])), lambda w: w["normal"] == v["normal"])
        kept = F.filter(o["values"], lambda v, i: (v["normal"] != "") & ~later(v, i))
        good = lambda p: F.when((p >= 0) & ~F.isnan(p) & (p < float("inf")), p)
        return F.transform(kept, lambda v: F.struct(v["normal"].alias("normal"), v["value"].alias("value"), good(v["price"]).alias("price")))

    def indexed(named: Column) -> Column:
        names = F.transform(named, lambda x: x["axis"])
        shared = F.array_sort(F.array_distinct(F.filter(names, lambda n: F.size(F.filter(names, lambda m: m == n)) > 1)))
        return bound(shared, lambda s: F.struct(F.filter(named, lambda x: ~F.array_contains(s, x["axis"])).alias("axes"), s.alias("collisions")))

    return bound(F.transform(options, lambda o: F.struct(canonical_axis(o["axis"]).alias("axis"), o["axis"].alias("source"), values(o).alias("values"))), indexed)


def variant_price(index: Column, chosen: Column, variants: Column, pricing: Column) -> Column:
    """RWD3: struct of status, price, method and axis: what a selection costs, by the first rung that tells.

    index: axis_index(); chosen: map axis -> value, normal texts; variants: array of struct (options: such a map,
    price); pricing: the product's base prices. Rungs: axes that collide; a variant with just these options and a
    price; more than one axis whose values differ in price; the one such axis, by its chosen value; one price over all
    values; a product without axes and with one base price. A price below zero or not finite is none; of several
    variants with the same options the first counts; a variant whose own axes collide fits nothing.
    """
    good = lambda p: F.when((p >= 0) & ~F.isnan(p) & (p < float("inf")), p)
    settled = lambda m: F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct(canonical_axis(e["key"]).alias("axis"), e["value"].alias("value"))))
    bases = F.array_distinct(F.filter(F.transform(F.coalesce(pricing, F.array().cast("array<double>")), good), lambda p: p.isNotNull()))
    none = F.array().cast("array<struct<options:map<string,string>,price:double>>")

    def told(method: str, price: Column | None = None, axis: Column | None = None) -> Column:
        status, empty = "unverifiable" if price is None else "pass", F.lit(None)
        price, axis = (empty if price is None else price).cast("double"), (empty if axis is None else axis).cast("string")
        return F.struct(F.lit(status).alias("status"), price.alias("price"), F.lit(method).alias("method"), axis.alias("axis"))

    def rungs(x: Column) -> Column:
        axes, picks = x["index"]["axes"], x["picks"]
        names = F.transform(picks, lambda e: e["axis"])
        clash = picks.isNull() | (F.size(x["index"]["collisions"]) > 0) | (F.size(F.array_distinct(names)) < F.size(names))
        fitting = F.filter(F.coalesce(variants, none), lambda v: settled(v["options"]) == picks)
        whole = good(F.get(fitting, F.lit(0))["price"])
        priced = lambda a: F.array_distinct(F.filter(F.transform(a["values"], lambda v: v["price"]), lambda p: p.isNotNull()))
        moving = F.filter(axes, lambda a: F.size(priced(a)) > 1)
        axis = F.get(moving, F.lit(0))
        pick = F.get(F.filter(picks, lambda e: e["axis"] == axis["axis"]), F.lit(0))
        entry = F.get(F.filter(axis["values"], lambda v: v["normal"] == pick["value"]), F.lit(0))["price"]
        every = F.array_distinct(F.flatten(F.transform(axes, priced)))
        return (
            F.when(clash, told("invalid_option_axes"))
            .when(whole.isNotNull(), told("full_variant_combination", whole))
            .when(F.size(moving) > 1, told("multiple_effective_price_axes"))
            .when((F.size(moving) == 1) & pick.isNull(), told("effective_price_axis_unselected", axis=axis["axis"]))
            .when((F.size(moving) == 1) & entry.isNull(), told("selected_variant_price_missing", axis=axis["axis"]))
            .when(F.size(moving) == 1, told("unique_effective_price_axis", entry, axis["axis"]))
            .when(F.size(every) == 1, told("constant_option_price", F.get(every, F.lit(0))))
            .when((F.size(axes) == 0) & (F.size(bases) == 1), told("single_base_price", F.get(bases, F.lit(0))))
            .otherwise(told("price_not_deterministic"))
        )

    return bound(F.struct(index.alias("index"), settled(chosen).alias("picks")), rungs)


def candidate_options(index: Column, required: Column) -> Column:
    """RWD4: struct of status, reason, axis and chosen (source axis -> value) for a product's axis_index().

    required: map canonical axis -> normal value. Its axes are settled first, in its order; the first one that the
    product lacks, or whose value it lacks, decides. Every other axis takes its cheapest value, priced ones first,
    ties by the normal text.
    """
    return bound(index, lambda i: _candidate(i, required))


def _candidate(index: Column, required: Column) -> Column:
    axes = index["axes"]
    keys = F.coalesce(F.map_keys(required), F.array().cast("array<string>"))
    axis_of = lambda k: F.get(F.filter(axes, lambda a: a["axis"] == k), F.lit(0))
    value_of = lambda k: F.get(F.filter(axis_of(k)["values"], lambda v: v["normal"] == required[k]), F.lit(0))
    trouble = lambda k: F.when(axis_of(k).isNull(), "candidate_axis_missing").when(value_of(k).isNull(), "candidate_required_value_missing")
    first = F.get(F.filter(F.transform(keys, lambda k: F.struct(k.alias("axis"), trouble(k).alias("reason"))), lambda t: t["reason"].isNotNull()), F.lit(0))
    free = F.filter(axes, lambda a: ~F.array_contains(keys, a["axis"]))
    bare = F.get(F.filter(free, lambda a: F.size(a["values"]) == 0), F.lit(0))
    by_price = lambda v: F.struct(v["price"].isNull().alias("none"), F.coalesce(v["price"], F.lit(0.0)).alias("price"), v["normal"].alias("normal"), v["value"].alias("value"))
    cheapest = lambda a: F.array_min(F.transform(a["values"], by_price))["value"]
    picks = F.concat(
        F.transform(keys, lambda k: F.struct(axis_of(k)["source"].alias("key"), value_of(k)["value"].alias("value"))),
        F.transform(free, lambda a: F.struct(a["source"].alias("key"), cheapest(a).alias("value"))),
    )
    why = (
        F.when(required.isNull(), "missing_contract").when(F.size(index["collisions"]) > 0, "candidate_axis_collision")
        .when(first.isNotNull(), first["reason"]).when(bare.isNotNull(), "candidate_axis_has_no_values")
    )
    axis = F.when(why == "candidate_axis_has_no_values", bare["axis"]).when(why.isin("candidate_axis_missing", "candidate_required_value_missing"), first["axis"])
    return bound(F.struct(why.alias("reason"), axis.alias("axis")), lambda w: _choice(w, picks))


def _choice(why: Column, picks: Column) -> Column:
    reason = why["reason"]
    status = F.when(reason.isNull(), "pass").when(reason == "candidate_required_value_missing", "fail").otherwise("unverifiable")
    return F.struct(status.alias("status"), reason.alias("reason"), why["axis"].alias("axis"), F.when(reason.isNull(), F.map_from_entries(picks)).alias("chosen"))


def explicit_brand(instruction: Column, title: Column, shop: Column, aliases: dict[str, list[str]]) -> Column:
    """STR8: sorted brands an instruction names: those with an alias of two characters or more in it and in title or shop,
    and the longest beginning (12 to 2 characters) of the shop's name, without its suffix, that it and the title hold. Normal texts."""
    target = F.concat_ws(" ", title, shop)
    table = [(a, name) for name, others in aliases.items() for a in (name, *others) if len(a) >= 2]
    named = [F.when(F.contains(instruction, F.lit(a)) & F.contains(target, F.lit(a)), F.lit(name)) for a, name in table]
    cut = F.regexp_replace(F.coalesce(shop, F.lit("")), f"({'|'.join(SHOP_SUFFIXES)})$", "")
    heads = F.transform(F.sequence(F.lit(12), F.lit(2), F.lit(-1)), lambda n: F.when(F.length(cut) >= n, F.substr(cut, F.lit(1), n)))
    head = F.get(F.filter(heads, lambda h: F.contains(instruction, h) & F.contains(title, h)), F.lit(0))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*named, head))))


def first_in(x: Column, names: list[str]) -> Column:
    """STR20: the first of the names, in the list's order, that stands in the text; the text itself if none does."""
    return F.coalesce(*[F.when(F.contains(x, F.lit(n)), F.lit(n)) for n in names], x)


def size_class(x: Column, patterns: list[str]) -> Column:
    """STR20: the first pattern, in the list's order, found in the text, else numeric_size or not_matched."""
    found = [F.when(x.rlike(p), F.lit(p)) for p in patterns]
    return F.coalesce(*found, F.when(x.rlike(r"^([0-9]+\.?[0-9]*|\.[0-9]+)$"), F.lit("numeric_size")), F.lit("not_matched"))


def requirement_count(core: Column, axes: Column, unresolved: Column, brand: Column, model: Column, upper: Column) -> Column:
    """AG28: struct of the independent requirements by kind and their total. Repeats, blanks and case of axes do not count."""
    distinct = lambda a: F.size(F.array_distinct(F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda v: F.trim(v)), lambda v: v != "")))
    parts = {
        "core": distinct(core), "axes": distinct(F.transform(axes, F.lower)), "unresolved": distinct(unresolved),
        "brand": F.coalesce(F.size(brand) > 0, F.lit(False)).cast("int"), "model": F.coalesce(F.size(model) > 0, F.lit(False)).cast("int"), "budget": upper.isNotNull().cast("int"),
    }
    return F.struct(*[c.alias(n) for n, c in parts.items()], sum(parts.values(), F.lit(0)).alias("total"))


def plain_text(x: Column) -> Column:
    """STR1: folded text of letters and digits alone."""
    return F.regexp_replace(F.coalesce(nfkc_casefold(x.cast("string")), F.lit("")), r"(?U)[\W_]+", "")


def verified_purchase(goal: dict[str, Column], bought: dict[str, Column], same: list[list[str]] = SAME_TEXT) -> Column:
    """RWD13: struct of valid, correct, type, reason and the names of the checks that failed.

    goal: reference, category (leaf), brands, models, attributes, options (arrays), upper. bought: asin, category
    (leaf), text, options (array), price. Texts by plain_text(); null or empty where there is none. A check without
    evidence makes the verdict invalid before any failed one counts.
    """
    none = F.array().cast("array<string>")
    text, options = F.coalesce(bought["text"], F.lit("")), F.filter(F.coalesce(bought["options"], none), lambda v: v != "")
    check = lambda name, passed, seen: F.struct(name.alias("name"), F.coalesce(passed, F.lit(False)).alias("passed"), seen.alias("seen"))

    def holds(v: Column) -> Column:
        alike = F.lit(False)
        for group in same:
            alike = alike | (v.isin(group) & (F.contains(text, F.lit(group[0])) | F.contains(text, F.lit(group[1]))))
        return ((v != "") & F.contains(text, v)) | alike

    each = lambda kind: F.transform(F.coalesce(goal[kind], none), lambda v: check(F.concat(F.lit(kind[:-1] + ":"), v), holds(v), text != ""))
    matched = lambda v: F.exists(options, lambda o: F.contains(o, v) | F.contains(v, o))
    one = lambda wanted, c: F.when(wanted, F.array(c)).otherwise(F.slice(F.array(c), 1, 0))
    checks = F.concat(
        one(goal["category"].isNotNull(), check(F.lit("category"), goal["category"] == bought["category"], bought["category"].isNotNull())),
        each("brands"), each("models"), each("attributes"),
        F.transform(F.coalesce(goal["options"], none), lambda v: check(F.concat(F.lit("option:"), v), matched(v), F.size(options) > 0)),
        one(goal["upper"].isNotNull(), check(F.lit("price_upper"), bought["price"] <= goal["upper"], bought["price"].isNotNull())),
    )
    def verdict(checks: Column) -> Column:
        reason = (
            F.when(F.coalesce(bought["asin"], F.lit("")) == "", "no_purchase").when(F.size(checks) == 0, "requirements_empty")
            .when(F.exists(checks, lambda c: ~c["seen"]), "purchase_evidence_missing").when(F.exists(checks, lambda c: ~c["passed"]), "requirements_not_satisfied")
        )
        kind = F.when(reason.isNotNull(), "unsuccessful_purchase").when(goal["reference"] == bought["asin"], "gold_purchase").otherwise("valid_alternative_purchase")
        failed = F.transform(F.filter(checks, lambda c: ~c["passed"]), lambda c: c["name"])
        valid = reason.isNull() | reason.isin("no_purchase", "requirements_not_satisfied")
        return F.struct(valid.alias("valid"), reason.isNull().alias("correct"), kind.alias("type"), reason.alias("reason"), F.when(reason == "no_purchase", none).otherwise(failed).alias("failed"))

    return bound(checks, verdict)


def draft_scores(b: dict[str, Column]) -> Column:
    """RWD16: struct of five heuristic draft scores, 0 to 2, from a trajectory's behaviour counts.

    b: searches, queries (different ones), opened, products (different ones), details, selected, purchases, correct,
    looped, invalid, termination, repeats.
    """
    two = lambda n, more: F.when(n == 0, 0).when(more, 2).otherwise(1)
    seen = two(b["opened"], (b["details"] > 0) | (b["selected"] > 0))
    decided = F.when(b["correct"], F.when(seen >= 1, 2).otherwise(1)).when(b["purchases"] > 0, 0).otherwise(1)
    stuck = b["looped"] | (b["invalid"] > 0) | F.contains(F.coalesce(b["termination"], F.lit("")), F.lit("max_"))
    ended = F.when(stuck, 0).when(b["repeats"] > 0, 1).otherwise(2)
    return F.struct(
        two(b["searches"], b["queries"] >= 2).alias("search_strategy"), two(b["opened"], b["products"] >= 2).alias("candidate_utilization"),
        seen.alias("evidence_verification"), decided.alias("decision_quality"), ended.alias("termination_efficiency"),
    )
