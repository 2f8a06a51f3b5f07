"""Actions against the page that a session saw last: page parsers, an as-of join and ordered reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Arguments that tools take, what the clicking tools press (null: their argument), buttons that are no options, marks of a page.
TOOLS = {
    "search_products": ("query",), "open_product": ("asin",), "select_option": ("value",), "view_description": (), "view_features": (), "view_reviews": (), "view_attributes": (),
    "next_page": (), "prev_page": (), "back_to_search": (), "buy_now": (), "finish_without_purchase": ("reason",), "think": ("note",),
}
PRESSES = {
    "select_option": None, "view_description": "description", "view_features": "features", "view_reviews": "reviews", "view_attributes": "attributes",
    "next_page": "next >", "prev_page": "< prev", "back_to_search": "back to search", "buy_now": "buy now",
}
NAVIGATION = ("description", "features", "reviews", "attributes", "next >", "< prev", "back to search", "buy now")
PRODUCT_ID = "[0-9]{8,12}"
NO_SEARCH, CAN_SEARCH, BUTTONS = "搜索功能是否可用: False", "搜索功能是否可用: True", "可点击的按钮"
STRUCTURED, RESULTS, PRICE = "[SHOPPING_OBSERVATION_V2]", "page_type: search_results", "价格:"
FINISH_REASON = "no_suitable_product"

#: Positions of a session that one window holds.
CHUNK = 1024


def product_ids(page: Column) -> Column:
    """STR19: ids of the products that a page lists, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(page, F.lit(rf"(?m)^[0-9]+\|({PRODUCT_ID})\|"), 1))


def clickable_buttons(page: Column) -> Column:
    """STR19: the buttons of a page's footer; none if the footer is missing or no JSON array. What is no text is left out."""
    found = F.regexp_extract(page, BUTTONS + r":\s*(\[[^\n]*\])", 1)
    items = F.from_json(found, "array<variant>")
    texts = F.filter(items, lambda v: F.schema_of_variant(v) == "STRING")
    return F.coalesce(F.transform(texts, lambda v: F.variant_get(v, "$", "string")), F.array().cast("array<string>"))


def page_type(page: Column) -> Column:
    """STR19: search_results, product_detail, search_home, information_subpage or generic, by the first rule that holds."""
    buttons = F.transform(clickable_buttons(page), F.lower)
    back = F.array(F.lit("back to search"), F.lit("< prev"))
    listed = page.rlike(r"(?:^|\[SEP\]\s*)Page [0-9]+") & (F.size(product_ids(page)) > 0)
    return (
        F.when((F.contains(page, F.lit(STRUCTURED)) & F.contains(page, F.lit(RESULTS))) | listed, "search_results")
        .when(F.array_contains(buttons, "buy now") | F.contains(page, F.lit(PRICE)), "product_detail")
        .when(F.contains(page, F.lit(CAN_SEARCH)), "search_home")
        .when((F.size(buttons) > 0) & (F.size(F.array_except(buttons, back)) == 0), "information_subpage")
        .otherwise("generic")
    )


def parsed(page: Column) -> Column:
    """What the guard needs of a page: whether there is one, whether it bars searching, its ids and its buttons in lower case."""
    text = F.coalesce(page, F.lit(""))
    return F.struct((text != "").alias("there"), F.contains(text, F.lit(NO_SEARCH)).alias("barred"), product_ids(text).alias("ids"), F.transform(clickable_buttons(text), F.lower).alias("buttons"))


def reject_reason(name: Column, arguments: Column, page: Column) -> Column:
    """FLT11: why a call may not run on a page (parsed()), null if it may; arguments: map of texts.

    Rungs in order: arguments that the tool does not take; tools that need no page; no page; a product that is not
    listed; an unknown tool or a lacking argument; a navigation button as an option; a button that is not there.
    """
    given = F.coalesce(arguments, F.create_map().cast("map<string,string>"))
    takes = F.create_map(*[x for tool, names in TOOLS.items() for x in (F.lit(tool), F.array(*[F.lit(n) for n in names]).cast("array<string>"))])[name]
    extra = F.when(takes.isNotNull(), F.array_sort(F.array_except(F.map_keys(given), takes)))
    fixed = F.create_map(*[x for tool, press in PRESSES.items() if press for x in (F.lit(tool), F.lit(press))])[name]
    target = F.when(name == "select_option", F.lower(given["value"])).otherwise(fixed)
    there = F.coalesce(page["there"], F.lit(False))
    has = lambda items, x: F.coalesce(F.array_contains(items, x), F.lit(False))
    gone = F.lit("click_not_in_previous_observation")
    none = F.lit(None).cast("string")
    return (
        F.when(F.coalesce(F.size(extra) > 0, F.lit(False)), F.concat(F.lit("schema_extra_arguments:"), F.concat_ws(",", extra)))
        .when(name == "think", none)
        .when(name == "finish_without_purchase", F.when(~given["reason"].eqNullSafe(F.lit(FINISH_REASON)), "invalid_finish_reason"))
        .when(name == "search_products", F.when(F.coalesce(page["barred"], F.lit(False)), "search_not_available_on_current_page"))
        .when(~there, "missing_previous_observation")
        .when(name == "open_product", F.when(~has(page["ids"], F.coalesce(given["asin"], F.lit(""))), gone))
        .when(target.isNull(), "unknown_or_invalid_tool")
        .when((name == "select_option") & target.isin(*NAVIGATION), "select_option_is_navigation_button")
        .when(~has(page["buttons"], target), gone)
    )


def latest(calls: DataFrame, pages: DataFrame, session: str, position: str, page: str, chunk: int = CHUNK) -> DataFrame:
    """JN9: calls with the last page of their session from before their position (an integer), null without one.

    Calls and pages are one stream of rows, never pairs. A window holds the rows of chunk positions of a session,
    so a session with a third of all rows is cut; the last page of every chunk is handed on by a row for each chunk.
    Of several pages at one position the greatest by value counts.
    """
    names = [c for c in calls.columns if c != page]
    cut = F.floor(F.col(position) / chunk)
    call = calls.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_call"), F.col(session).alias("_s"), F.col(position).alias("_p"), F.lit(None).cast(pages.schema[page].dataType).alias("_page"), cut.alias("_c"))
    shown = pages.groupBy(session, position).agg(F.max(page).alias(page))
    seen = shown.select(F.lit(None).cast(call.schema["_call"].dataType).alias("_call"), F.col(session).alias("_s"), F.col(position).alias("_p"), F.col(page).alias("_page"), cut.alias("_c"))
    rows = call.union(seen)
    # a call stands before the page that has its position
    near = F.last("_page", ignorenulls=True).over(Window.partitionBy("_s", "_c").orderBy("_p", F.col("_call").isNull()).rowsBetween(Window.unboundedPreceding, -1))
    by_chunk = rows.groupBy("_s", "_c").agg(F.max_by("_page", F.when(F.col("_page").isNotNull(), F.col("_p"))).alias("_last"))
    before = F.last("_last", ignorenulls=True).over(Window.partitionBy("_s").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1))
    handed = by_chunk.select(F.col("_s").alias("_t"), F.col("_c").alias("_d"), before.alias("_before"))
    found = rows.withColumn("_near", near).filter("_call IS NOT NULL")
    joined = found.join(handed, F.col("_s").eqNullSafe(F.col("_t")) & F.col("_c").eqNullSafe(F.col("_d")))
    return joined.select("_call.*", F.coalesce("_near", "_before").alias(page))


def guarded(calls: DataFrame, pages: DataFrame, session: str, position: str, name: str, arguments: str, page: str) -> DataFrame:
    """FLT11: calls with reason, why each may not run on the page its session saw last. Pages are parsed once, before they are joined."""
    read = pages.filter(F.col(page).isNotNull()).select(session, position, parsed(F.col(page)).alias("_parsed"))
    met = latest(calls, read, session, position, "_parsed")
    return met.withColumn("reason", reject_reason(F.col(name), F.col(arguments), F.col("_parsed"))).drop("_parsed")
