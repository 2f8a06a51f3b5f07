"""Rules, comparators, penalties and planners on literal rows, one for each case that the data's tables lack."""

import html.parser
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from trailmill.functions import numerals, outcomes, prices, process, products
from trailmill.operators import events, planning, sampling
from trailmill.registry import QUERIES
from trailmill.sources import files

DIR = "/root/testdata/sf0.001"


def one(spark, *columns, **row):
    """The columns' values over one row."""
    schema = ", ".join(f"{k} {t}" for k, (t, _) in row.items()) or "x int"
    df = spark.createDataFrame([tuple(v for _, v in row.values()) or (1,)], schema)
    return tuple(df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


FIELDS = ("release_error", "error_category", "error_type", "reward_type", "status", "termination_reason", "termination_category")
FLAGS = ("infrastructure_invalid", "done", "reward_valid")


def attempt(spark, rule, **given):
    f = {c: F.lit(given.get(c)).cast("string") for c in FIELDS} | {c: F.lit(given.get(c)).cast("boolean") for c in FLAGS}
    f["mechanical"] = F.lit(given.get("mechanical", [])).cast("array<string>") if given.get("mechanical") else F.array().cast("array<string>")
    return spark.range(1).select(rule(f).alias("r")).first()["r"]


@pytest.mark.parametrize("given, want", [
    ({"release_error": "x", "reward_type": "gold_purchase"}, ("infrastructure_error", False, None, "retry", ["environment_release_failed"])),
    ({"infrastructure_invalid": True, "reward_type": "reward_unverifiable"}, ("reward_unverifiable", False, None, "retry", ["reward_unverifiable"])),
    ({"error_category": "policy"}, ("protocol_error", False, None, "retry", ["error_category:policy"])),
    ({"done": True}, ("infrastructure_error", False, None, "retry", ["terminal_reward_not_valid"])),
    ({"done": True, "reward_valid": True, "reward_type": "gold_purchase"}, ("gold_purchase", True, True, "accepted_gold", [])),
    ({"done": True, "reward_valid": True, "reward_type": "gold_purchase", "mechanical": ["has_guard_rejection"]}, ("gold_purchase", True, True, "rejected", ["has_guard_rejection"])),
    ({"done": True, "reward_valid": True, "reward_type": "wrong_purchase"}, ("wrong_purchase", True, False, "rejected", ["terminal_outcome:wrong_purchase"])),
    ({"status": "max_steps"}, ("max_steps", True, False, "rejected", ["non_success_status:max_steps"])),
    ({"error_category": "model"}, ("model_error", True, False, "rejected", ["non_success_status:unknown"])),
    ({}, ("no_purchase", True, False, "rejected", ["non_success_status:unknown"])),
])
def test_classified(spark, given, want):
    assert tuple(attempt(spark, outcomes.classified, **given)) == want


def test_eligibility(spark):
    e = lambda **g: tuple(attempt(spark, outcomes.eligibility, **g))
    assert e(error_category="policy", error_type="ContextLimit") == ("eligible", "model", "context_or_action_budget_exhausted")
    assert e(error_category="policy", error_type="Other") == ("non_model_invalid", "non_model", "runtime_error:policy")
    assert e(status="error") == ("non_model_invalid", "undetermined", "unclassified_runtime_error")
    assert e() == ("eligible", "undetermined", None)


def test_dimension_counts_are_checked(spark):
    d = lambda r, p, bought: spark.range(1).select(outcomes.dimension(F.lit(r), F.lit(p), F.lit(p), F.lit(bought)).alias("d")).first()["d"]
    assert d(4, 3, True)["ratio"] == 0.75 and d(0, 0, True)["ratio"] == 1.0 and d(0, 0, False)["ratio"] == 0.0
    with pytest.raises(Exception, match="invalid dimension"):
        d(1, 2, True)


def test_comparators(spark):
    lit = lambda xs: F.array(*[F.lit(x) for x in xs])
    get = lambda c: spark.range(1).select(c.alias("c")).first()["c"]
    # a model inside a longer one is none; a number beside letters is none
    assert [get(products.model_match(F.lit(a), F.lit(b))) for a, b in (("x100", "phone x100 pro"), ("x100", "phone x1000"), ("x100", "xx100"), ("a.b", "acb"), ("手机", "手机"), ("", "x"))] == [True, False, False, False, True, False]
    path = lambda x: products.category_path(F.lit(x))
    paths = spark.range(1).select(path("Home›Kitchen›Pots").alias("a"), path("kitchen › pots").alias("b"), path("Garden›Pots").alias("c"), path("").alias("e"), path("Pots").alias("d"))
    assert tuple(paths.select(*[products.category(F.col(x), F.col(y)) for x, y in ("ab", "ac", "ad", "ae")]).first()) == ("pass", "fail", "pass", "unverifiable")
    assert [get(products.occurrence(F.lit(t), F.lit("糖"))) for t in ("无糖", "含糖", "没有糖但有糖", "盐")] == [None, True, True, False]
    assert get(products.core_functions(lit(["防水"]), lit(["不防水"]), F.lit("防水"))) == "fail"
    assert get(products.core_functions(lit(["防水"]), lit(["轻"]), F.lit("很防水"))) == "pass"
    assert get(products.core_functions(lit([]), lit(["轻"]), F.lit(""))) == "unverifiable"
    assert get(products.model_tokens(F.lit("the rtx4090 and wh-1000xm5, plain 2024 a1 7 x " + "9" * 25))) == ["rtx4090", "wh-1000xm5", "2024", "a1"]
    assert get(products.model_tokens(F.lit("3000 12345 iphone-15.pro+"))) == ["3000", "12345", "iphone-15.pro+"]
    assert get(products.occurrence(F.lit("不支持快充"), F.lit("快充"))) is None and get(products.occurrence(F.lit("不支持快充，有快充头"), F.lit("快充"))) is True
    assert [get(products.price_gate(F.lit(p).cast("double"), F.lit(s), F.lit(u).cast("double"))) for p, s, u in ((5, "pass", None), (5, "fail", 9), (5, "pass", 9), (5, "pass", 4), (-1, "pass", 4))] == ["pass", "unverifiable", "pass", "fail", "unverifiable"]
    aliases = {"acme": ["阿克米", "ac"]}
    assert [get(products.brand_gate(F.lit(e), F.lit(t), aliases)) for e, t in (("acme", "阿克米旗舰店"), ("阿克米", "acme"), ("other", "acme"), ("shop", "theshop"))] == ["pass", "pass", "fail", "pass"]


def test_options(spark):
    row = spark.sql("SELECT map('colour', 'red', 'size', 'xl') AS need, map('colour', array('red', 'blue'), 'size', array('m', 'xl')) AS axes")
    sel = lambda x: tuple(row.select(products.required_options(F.col("need"), F.col("axes"), F.expr(x)).alias("r")).first()["r"])
    assert sel("map('colour', 'red', 'size', 'xl')") == ("pass", [], [], [])
    assert sel("map('colour', 'blue')") == ("fail", [], [], ["colour", "size"])
    assert row.select(products.required_options(F.expr("map('weight', '1')"), F.col("axes"), F.expr("map('a', 'b')")).alias("r")).first()["r"]["status"] == "unverifiable"


@pytest.mark.parametrize("text, want", [
    ("预算2万5千左右", 27500.0), ("预算100-200元", 200.0), ("价格在1千到2千", 2000.0), ("预算4k+", None), ("预算3000左右", 3300.0), ("不超过2万元", 20000.0), ("50元以内", 50.0), ("价格1,500元", 1500.0), ("便宜", None), (None, None),
    ("预算1万8千元以内", 18000.0), ("最高3千元", 3000.0), ("价格控制在2k-3k之间", 3000.0), ("预算500到300元", None), ("价格80元以下", 80.0), ("预算0元，100元以内", 100.0), ("不超过5k", None), ("预算12.5万", 125000.0), ("共3件，价格在99.9元内", 99.9),
])
def test_upper_budget(spark, text, want):
    got = spark.range(1).select(prices.upper_budget(F.lit(text).cast("string")).alias("b")).first()["b"]
    assert got == (pytest.approx(want) if want is not None else None)


def test_penalties(spark):
    steps = "array(named_struct('tool', 'search_products', 'value', '', 'progress_added', array(), 'no_progress_steps', 3), named_struct('tool', 'select_option', 'value', 'red', 'progress_added', array(), 'no_progress_steps', 0), named_struct('tool', 'select_option', 'value', 'red', 'progress_added', array(), 'no_progress_steps', 0), named_struct('tool', 'buy_now', 'value', '', 'progress_added', array(), 'no_progress_steps', 9))"
    f = lambda wrong, price, bought=True: {"purchased": F.lit(bought), "sampling_invalid": F.lit(False), "category_status": F.lit("pass"), "price_status": F.lit(price), "wrong_values": F.array(*[F.lit(w) for w in wrong]), "missing_axes": F.array().cast("array<string>")}
    run = lambda x: [tuple(r) for r in spark.range(1).select(process.penalties(F.expr(steps), x).alias("p")).first()["p"]]
    idle, none = (-0.25, ["sustained_no_progress"], "no_progress"), (0.0, [], "normal")
    assert run(f(["red"], "pass")) == [idle, none, (-0.5, ["wrong_option"], "wrong_option"), none]
    assert run(f(["blue"], "fail")) == [idle, none, none, (-1.0, ["invalid_price_buy", "unlocated_wrong_option"], "bad_buy")]
    assert run(f(["red"], "fail", False)) == [idle, none, none, none]


def test_arrays(spark):
    get = lambda c: spark.range(1).select(c.alias("c")).first()["c"]
    arr = lambda xs: F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<int>")
    assert [get(process.group_ends(arr(m))) for m in ([1, 1, 0, 1, 0, 0], [1, 1], [0, 1, 0], [], [1, 0])] == [[3, 6], [], [], [], [2]]
    assert [get(process.common_prefix(arr(a), arr(b))) for a, b in (([1, 2, 3], [1, 2, 4]), ([1], [1, 2]), ([], [1]), ([2], [1]))] == [2, 1, 0, 0]
    assert [tuple(get(process.decoded_arguments(F.lit(x).cast("string")))) for x in ('{"a": "1"}', "[1]", "{", None, " ")] == [({"a": "1"}, None), (None, "not_object"), (None, "not_json"), (None, "missing"), (None, "missing")]


def test_messages_without_blocked_calls(spark):
    m = spark.createDataFrame([([("user", "hi", None, None, None), ("assistant", "", [("c1", "f", "{}")], None, None), ("tool", "no", None, "c1", "f"), ("assistant", "", [("c2", "f", "{}"), ("c1", "f", "{}")], None, None)], ["c1"])], "messages array<struct<role:string,content:string,tool_calls:array<struct<id:string,name:string,arguments:string>>,tool_call_id:string,name:string>>, blocked array<string>")
    assert [r["role"] for r in m.select(events.kept_messages(F.col("messages"), F.col("blocked")).alias("m")).first()["m"]] == ["user", "assistant"]


def test_panel_must_match(spark):
    t = spark.createDataFrame([(1,), (2,)], "id int")
    part = lambda ids: spark.createDataFrame([(i, "x") for i in ids], "id int, v string")
    assert events.panel(t, "id", part([1, 2]), part([2, 1])).count() == 2
    for ids in ([1], [1, 2, 3], [1, 2, 2]):
        with pytest.raises(Exception, match="panel 0"):
            events.panel(t, "id", part(ids)).collect()


def test_plans(spark):
    assert planning.pattern_plan({"easy": 1, "medium": 7, "hard": 3}) == ["easy", "medium", "medium", "hard", "medium", "medium", "medium", "hard", "medium", "hard", "medium"]
    df = spark.createDataFrame([(i, float(1 + 99 * (i < 20))) for i in range(400)], "id int, w double")
    got = {r["id"] for r in planning.weighted_pick(df, "id", "w", 40, "s").collect()}
    assert len(got) == 40 and sum(i < 20 for i in got) >= 15
    with pytest.raises(Exception, match="repeated key 1"):
        planning.batches([df.limit(0).union(spark.createDataFrame([(1, 1.0)], df.schema))] * 2, "id").collect()
    with pytest.raises(Exception, match="no row for 2"):
        planning.matched(spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(1, 5)], "id int, v int"), "id").collect()


def test_min_cost_flow():
    """Exact quotas at the least cost, against all choices; what cannot be met is an error."""
    rng = random.Random(4)
    for _ in range(20):
        cells = {(a, c): rng.randrange(1, 3) for a in "xy" for c in "pqrs" if rng.random() < 0.8}
        cost = {c: float(rng.randrange(1, 9)) for c in cells}
        quotas = {"x": 2, "y": 1}
        names = sorted(cells)
        best = None
        for mask in range(3 ** len(names)):
            take = {c: mask // 3**i % 3 for i, c in enumerate(names)}
            if all(take[c] <= cells[c] for c in names) and all(sum(n for c, n in take.items() if c[0] == a) == q for a, q in quotas.items()) and all(sum(n for c, n in take.items() if c[1] == k) <= 1 for k in "pqrs"):
                total = sum(cost[c] * n for c, n in take.items())
                best = total if best is None else min(best, total)
        if best is None:
            with pytest.raises(ValueError):
                sampling.min_cost_flow(cells, quotas, 1, cost)
        else:
            got = sampling.min_cost_flow(cells, quotas, 1, cost)
            assert sum(cost[c] * n for c, n in got.items()) == best


def test_content_digest(spark, tmp_path):
    schema = "a string, b string"
    d = lambda rows, s=schema: files.content_digest(spark.createDataFrame(rows, s))
    assert d([("x", None)]) != d([(None, "x")]) and d([("x", "y"), ("u", "v")]) == d([("u", "v"), ("x", "y")]) != d([("x", "y")])
    assert d([("1", "2")]) != d([(1, 2)], "a int, b int") and d([("x", "y")]) != d([("x", "y"), ("x", "y"), ("x", "y")])
    path = str(tmp_path / "frozen")
    assert [files.freeze(spark.createDataFrame([("x", None)], schema), path) for _ in range(2)] == ["written", "unchanged"]
    with pytest.raises(ValueError):
        files.freeze(spark.createDataFrame([(None, "x")], schema), path)
    one_, two = files.manifest(spark, path), files.manifest(spark, path).filter("name <> '_SUCCESS'")
    assert files.changed(one_, one_).count() == 0 and {r["problem"] for r in files.changed(one_, two).collect()} <= {"missing"}


@pytest.mark.parametrize("text, want", [("三", 3), ("十", 10), ("十五", 15), ("二十", 20), ("两百零五", 205), ("三千", 3000), ("一万二千", 12000), ("万", 10000), ("十二万三千四百五十六", 123456), ("", None), ("3", None)])
def test_han_number(spark, text, want):
    assert spark.range(1).select(numerals.han_number(F.lit(text)).alias("n")).first()["n"] == want


def test_texts_against_python(spark):
    """The queries without SQL of normal texts, tokens and visible text, on every row of the smallest tables."""
    import hashlib

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    punct = lambda t: re.sub(r"\s+", " ", re.sub(r"[^\w\s]+", " ", unicodedata.normalize("NFKC", t).casefold().strip())).strip(" ")
    got = {r["doc_id"]: r["normal"] for r in QUERIES["query_normaliser"](spark, DIR).collect()}
    assert sum(got[i] == hashlib.md5(punct(t).encode()).hexdigest() for i, t in docs.items()) >= 0.99 * len(docs)
    counts = {r["doc_id"]: r["n_tokens"] for r in QUERIES["tokens_bigram"](spark, DIR).collect()}
    assert counts == {i: len(set(re.findall(r"[a-z0-9]+(?:[._+/-][a-z0-9]+)*", t.lower()))) for i, t in docs.items()}

    class Seen(html.parser.HTMLParser):
        def __init__(self):
            super().__init__()
            self.deep, self.words = 0, []

        def handle_starttag(self, tag, attrs):
            self.deep += tag in ("script", "style")

        def handle_endtag(self, tag):
            self.deep = max(0, self.deep - (tag in ("script", "style")))

        def handle_data(self, data):
            self.words += [] if self.deep else data.split()

    visible = {r["page_id"]: r["visible"] for r in QUERIES["html_visible_text"](spark, DIR).collect()}
    for r in spark.read.parquet(f"{DIR}/pages.parquet").collect():
        p = Seen()
        p.feed(r["html"])
        assert visible[r["page_id"]].split() == p.words


def test_plans_over_tables(spark):
    plan = QUERIES["interleaved_plan"](spark, DIR).orderBy("place").collect()
    labels = [r["c_mktsegment"] for r in plan]
    share = {x: labels.count(x) / len(labels) for x in set(labels)}
    assert [r["place"] for r in plan] == list(range(len(plan))) and len({r["c_custkey"] for r in plan}) == len(plan)
    for n in range(1, len(labels) + 1):
        assert all(abs(labels[:n].count(x) - share[x] * n) <= 1.5 for x in share)
    flow = QUERIES["mincost_category_plan"](spark, DIR).collect()
    assert len(flow) == 25 and len({r["n_name"] for r in flow}) == 25 and {[r["c_mktsegment"] for r in flow].count(x) for x in {r["c_mktsegment"] for r in flow}} == {5}
