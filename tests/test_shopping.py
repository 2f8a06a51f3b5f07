"""The shop queries without SQL against brute force, and literal price phrases."""

import hashlib
import json
import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F
from test_index import brute
from test_resampling import fold

from trailmill.functions import options, prices
from trailmill.operators import index
from trailmill.registry import QUERIES

DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def rows(sql):
    return duckdb.sql(sql.replace("DIR", DIR)).fetchall()


def test_indexed_topk(spark):
    items = rows("""SELECT item_id, name, brand, kind, 'm' || size, kind || ' ' || size, brand || '/' || size, concat_ws(' ', name, kind, floor(price)::BIGINT) FROM 'DIR/items.parquet'""")
    asked = [(q, q) for (q,) in rows("SELECT DISTINCT concat_ws(' ', name, brand) FROM 'DIR/items.parquet'")]
    got = QUERIES["indexed_topk"](spark, DIR).collect()
    assert sorted((r["query"], r["item_id"], r["rank"], round(r["score"], 5)) for r in got) == sorted((q, i, n, round(s, 5)) for q, i, n, s in brute(items, asked, 20, index.WEIGHTS))


def test_strict_lines(spark):
    want = rows("SELECT conv_id, turn, role, text FROM 'DIR/conversations.parquet'")
    got = QUERIES["strict_lines"](spark, DIR).collect()
    size = lambda r: len(json.dumps(dict(zip(("conv_id", "turn", "role", "text"), r)), ensure_ascii=False, separators=(",", ":")).encode()) + 1
    assert sorted((r["conv_id"], r["turn"], r["n_bytes"], r["text_sha256"]) for r in got) == sorted((r[0], r[1], size(r), hashlib.sha256(r[3].encode()).hexdigest()) for r in want)
    first = {}
    for r in got:
        first.setdefault(r["conv_id"], []).append((r["turn"], r["number"]))
    assert all(len({n - t for n, t in zip(sorted(x[1] for x in v), range(len(v)))}) == 1 for v in first.values())  # a conversation's lines follow on each other


def test_resampled_updates(spark):
    sales = spark.read.parquet(f"{DIR}/sales.parquet").filter("client_id IS NOT NULL").select(F.col("client_id").cast("string"), F.floor(F.coalesce("total", F.lit(0.0)) % 7 / 4).cast("double"), F.coalesce(F.col("status") != "held", F.lit(False)), F.pmod(F.xxhash64("sale_id"), F.lit(6))).collect()
    parts = [[(g, u, u, ok, 0) for g, u, ok, p in sales if p == part] for part in range(6)]
    got = QUERIES["resampled_updates"](spark, DIR).orderBy("batch").collect()
    assert [r["outcome"] for r in got] == fold(parts, 100, 3, 10)[0]
    assert sum(r["generated"] for r in got if r["batch"] == 0) == len({r[0] for r in parts[0]})


U, L, P, A, R = "explicit_upper_budget_rule", "explicit_lower_price_rule", "explicit_plus_lower_rule", "approximate_price_preference_rule", "explicit_price_range_rule"


@pytest.mark.parametrize("text, want", [
    ("预算不超过1万2，红色", [(U, None, 12000.0, 0, 8)]), ("要最高1万2千元", [(U, None, 12000.0, 0, 8)]), ("1万2000元以内", [(U, None, 12000.0, 0, 9)]), ("封顶在3k", [(U, None, 3000.0, 0, 5)]),
    ("价格在100元-200元之间，50元以上", [(R, 100.0, 200.0, 0, 14), (L, 50.0, None, 15, 20)]), ("200-100元", []), ("100-200元以内", [(R, 100.0, 200.0, 0, 8)]),
    ("不超过100 不超过200", [(U, None, 100.0, 0, 7), (U, None, 200.0, 7, 13)]), ("至少50元以上", [(L, 50.0, None, 0, 5)]), ("不高于80", [(U, None, 80.0, 0, 5)]), ("高于80", [(L, 80.0, None, 0, 4)]),
    ("3千+ 左右", [(P, 3000.0, None, 0, 3)]), ("预算500左右", [(A, 500.0, 500.0, 0, 7)]), ("500元以内左右", [(U, None, 500.0, 0, 6)]), ("10起，0元以内", [(L, 10.0, None, 0, 3), (U, None, 0.0, 4, 8)]), ("1万0以内", [(U, None, 10000.0, 0, 5)]), ("价格", []), (None, []), ("没有数字", []),
])
def test_price_candidates(spark, text, want):
    got = spark.range(1).select(prices.candidates(F.lit(text).cast("string")).alias("c")).first()["c"]
    assert [(c["rule"], c["low"], c["high"], c["start"], c["end"]) for c in got] == want
    assert all(c["text"] == text[c["start"] : c["end"]] for c in got)


def test_precedence_and_overlap():
    """A phrase accepted earlier bars those that overlap it; ranges stand whatever they overlap."""
    got = prices.candidates_of("不超过100到200元以内")
    assert [(c["rule"], c["start"], c["end"]) for c in got] == [(R, 3, 11)]
    got = prices.candidates_of("预算不超过1万2到3万")
    assert [(c["rule"], c["start"], c["end"]) for c in got] == [(U, 0, 8), (R, 7, 11)]


def test_drawn_budgets(spark):
    """Drawn bounds are the standard library's for every item; stated ones come first."""
    got = {r["item_id"]: r["upper"] for r in QUERIES["drawn_budgets"](spark, DIR).collect()}
    for i, name, size, price in rows("SELECT item_id, name, size, price FROM 'DIR/items.parquet'"):
        said = f"预算不超过{size + 1}元" if i % 8 == 0 else name
        if price is None or i % 8 == 0:
            assert got[i] == (None if price is None else size + 1)
            continue
        low = math.ceil(price / 10) * 10
        steps = 3 if price <= 100 else 10 if price <= 1000 else 50 if price <= 5000 else 100 if price <= 10000 else 4
        rng = random.Random(int.from_bytes(hashlib.sha256(f"{i}\0{said}".encode()).digest()[:8], "big"))
        assert got[i] == sorted(rng.sample([low + 10 * k for k in range(steps)], 2))[1]


def test_drawn_edges(spark):
    edge = spark.sql("SELECT 'a' AS k, CAST(NULL AS string) AS t, CAST('Infinity' AS DOUBLE) AS p UNION ALL SELECT NULL, 'x', CAST(1 AS DOUBLE) UNION ALL SELECT 'b', NULL, NULL")
    assert [r[0] for r in edge.select(prices.price_upper(F.col("k"), F.col("t"), F.col("p"))).collect()] == [None] * 3


def axis(name, *values):
    return f"named_struct('axis', '{name}', 'values', array(" + ", ".join(f"named_struct('normal', '{n}', 'value', '{n}', 'price', CAST({p} AS DOUBLE))" for n, p in values) + "))"


def test_variant_price(spark):
    def one(axes, chosen, variants="CAST(NULL AS array<struct<options:map<string,string>,price:double>>)", pricing="CAST(NULL AS array<double>)"):
        return tuple(spark.range(1).select(options.variant_price(options.axis_index(F.expr(axes)), F.expr(chosen), F.expr(variants), F.expr(pricing)).alias("p")).first()["p"])

    colour, size = axis("颜色", ("red", 5), ("blue", 6)), axis("尺码", ("m", "NULL"), ("l", "NULL"))
    full = "array(named_struct('options', map('颜色', 'red', '尺码', 'm'), 'price', CAST(9 AS DOUBLE)))"
    assert one(f"array({colour}, {size})", "map('尺码', 'm', '颜色分类', 'red')", full) == ("pass", 9.0, "full_variant_combination", None)
    assert one(f"array({colour}, {size})", "map('尺码', 'm', '颜色', 'red')", full.replace("CAST(9", "CAST(-9")) == ("pass", 5.0, "unique_effective_price_axis", "color")
    assert one(f"array({colour}, {size})", "map('尺码', 'm')") == ("unverifiable", None, "effective_price_axis_unselected", "color")
    assert one(f"array({colour}, {size})", "map('颜色', 'pink')") == ("unverifiable", None, "selected_variant_price_missing", "color")
    assert one(f"array({colour}, {axis('尺码', ('m', 1), ('l', 2))})", "map('颜色', 'red')")[2] == "multiple_effective_price_axes"
    assert one(f"array({axis('颜色', ('red', 5), ('blue', 5))}, {size})", "map('尺码', 'm')") == ("pass", 5.0, "constant_option_price", None)
    assert one(f"filter(array({size}), a -> false)", "map('尺码', 'm')", pricing="array(CAST(3 AS DOUBLE), CAST(3 AS DOUBLE), CAST(-1 AS DOUBLE))") == ("pass", 3.0, "single_base_price", None)
    assert one(f"array({size})", "map('尺码', 'm')", pricing="array(CAST(3 AS DOUBLE))")[2] == "price_not_deterministic"
    assert one(f"array({colour}, {axis('颜色分类', ('x', 1))})", "map('尺码', 'm')")[2] == "invalid_option_axes"
    assert one(f"array({colour})", "map('颜色', 'red', '颜色分类', 'blue')")[2] == "invalid_option_axes" == one(f"array({colour})", "CAST(NULL AS map<string,string>)")[2]
