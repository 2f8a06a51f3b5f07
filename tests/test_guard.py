"""The guard: literal pages and reasons, and the as-of join against a plain scan."""

import json
import random

import pytest
from pyspark.sql import functions as F

from trailmill.operators import guard

RESULTS = "[SEP] Page 1 (total 3)\n1|10000001|shoe|10\n2|10000002|shoe|20\n3|10000001|again\nx1|10000003|no\n可点击的按钮: [\"Next >\", \"Back to Search\", 7, null]\n"
DETAIL = '价格: 30\n可点击的按钮: ["Buy Now", "红色", "Description", "< Prev"]'
SUB = '可点击的按钮: ["< Prev", "Back to Search"]'
HOME = "搜索功能是否可用: True\n可点击的按钮: []"
BARRED = "搜索功能是否可用: False\n可点击的按钮: [\"< Prev\", \"X\"]"


def one(spark, c):
    return spark.range(1).select(c.alias("c")).first()["c"]


def test_parsers(spark):
    lit = lambda x: F.lit(x).cast("string")
    assert one(spark, guard.product_ids(lit(RESULTS))) == ["10000001", "10000002"]
    assert one(spark, guard.clickable_buttons(lit(RESULTS))) == ["Next >", "Back to Search"]
    for bad in ("", "可点击的按钮: [a]", "可点击的按钮: x", '可点击的按钮: {"a": []}'):
        assert one(spark, guard.clickable_buttons(lit(bad))) == []
    for page, kind in ((RESULTS, "search_results"), ("Page 2\n", "generic"), (DETAIL, "product_detail"), (SUB, "information_subpage"), (HOME, "search_home"), ("", "generic"), ("[SHOPPING_OBSERVATION_V2]\npage_type: search_results", "search_results"), (BARRED, "generic")):
        assert one(spark, guard.page_type(lit(page))) == kind


@pytest.mark.parametrize("name, arguments, page, reason", [
    ("search_products", {"query": "a"}, None, None), ("search_products", {"query": "a"}, BARRED, "search_not_available_on_current_page"), ("search_products", {"query": "a", "z": "1", "b": "2"}, BARRED, "schema_extra_arguments:b,z"),
    ("think", {"note": "x"}, None, None), ("think", {"x": "x"}, None, "schema_extra_arguments:x"), ("finish_without_purchase", {"reason": "no_suitable_product"}, None, None), ("finish_without_purchase", {}, DETAIL, "invalid_finish_reason"),
    ("open_product", {"asin": "10000001"}, "", "missing_previous_observation"), ("open_product", {"asin": "10000001"}, RESULTS, None), ("open_product", {"asin": "10000003"}, RESULTS, "click_not_in_previous_observation"), ("open_product", {}, RESULTS, "click_not_in_previous_observation"),
    ("fly", {"a": "b"}, RESULTS, "unknown_or_invalid_tool"), ("fly", None, None, "missing_previous_observation"), (None, None, RESULTS, "unknown_or_invalid_tool"), ("select_option", {}, DETAIL, "unknown_or_invalid_tool"),
    ("select_option", {"value": "红色"}, DETAIL, None), ("select_option", {"value": "Buy Now"}, DETAIL, "select_option_is_navigation_button"), ("select_option", {"value": "蓝色"}, DETAIL, "click_not_in_previous_observation"),
    ("buy_now", {}, DETAIL, None), ("buy_now", {}, SUB, "click_not_in_previous_observation"), ("prev_page", None, SUB, None), ("view_reviews", {}, DETAIL, "click_not_in_previous_observation"), ("view_description", {}, DETAIL, None),
])
def test_reasons(spark, name, arguments, page, reason):
    df = spark.createDataFrame([(name, arguments, page)], "n string, a map<string,string>, p string")
    assert df.select(guard.reject_reason(F.col("n"), F.col("a"), guard.parsed(F.col("p")))).first()[0] == reason


@pytest.mark.parametrize("chunk", [3, 10, 1024])
def test_latest_page(spark, chunk):
    rng = random.Random(chunk)
    calls = [(s, p, f"{s}-{p}-{i}") for s in ["a", "b", "hot", None] for p in range(80 if s == "hot" else 12) for i in range(rng.randrange(3))]
    pages = [(s, p, json.dumps([s, p])) for s in ["a", "hot", None, "lonely"] for p in range(-5, 80, rng.choice([1, 7, 30])) if rng.random() < 0.5]
    pages += [pages[0], (pages[0][0], pages[0][1], "!")]
    got = guard.latest(spark.createDataFrame(calls, "s string, p long, id string"), spark.createDataFrame(pages, "s string, p long, page string"), "s", "p", "page", chunk).collect()
    want = []
    for s, p, i in calls:
        before = [(q, page) for t, q, page in pages if t == s and q < p]
        want.append((s, p, i, max(before)[1] if before else None))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_guarded(spark):
    calls = spark.createDataFrame([("s", 1, "open_product", {"asin": "10000002"}), ("s", 0, "buy_now", {}), ("s", 4, "buy_now", {}), ("t", 9, "buy_now", {})], "s string, p long, name string, args map<string,string>")
    pages = spark.createDataFrame([("s", 0, RESULTS), ("s", 3, DETAIL), ("s", 2, None), ("s", 4, SUB)], "s string, p long, page string")
    got = {(r["s"], r["p"]): r["reason"] for r in guard.guarded(calls, pages, "s", "p", "name", "args", "page").collect()}
    assert got == {("s", 0): "missing_previous_observation", ("s", 1): None, ("s", 4): None, ("t", 9): "missing_previous_observation"}
