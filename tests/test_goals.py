"""Options, verifier, messages and collection runs on literal rows, one for each case that the data's tables lack."""

import pytest
from pyspark.sql import functions as F

from trailmill.functions import messages, options
from trailmill.operators import collection

OPTIONS = "array<struct<axis:string,values:array<struct<normal:string,value:string,price:double>>>>"


def one(spark, column, schema, *row):
    return spark.createDataFrame([row], schema).select(column.alias("r")).first()["r"]


def choose(spark, product, required):
    r = one(spark, options.candidate_options(options.axis_index(F.col("o")), F.col("q")), f"o {OPTIONS}, q map<string,string>", product, required)
    return r["status"], r["reason"], r["axis"], r["chosen"]


def test_candidate_options(spark):
    colour = ("颜色", [("red", "Red", 9.0), ("blue", "Blue", 5.0), ("red", "RED", 4.0)])
    size = ("尺码", [("m", "M", None), ("l", "L", float("nan")), ("s", "S", 7.0)])
    assert choose(spark, [colour, size], {}) == ("pass", None, None, {"颜色": "RED", "尺码": "S"})
    assert choose(spark, [colour, size], {"color": "blue"}) == ("pass", None, None, {"颜色": "Blue", "尺码": "S"})
    assert choose(spark, [("材质", [("b", "B", None), ("a", "A", None)])], {}) == ("pass", None, None, {"材质": "A"})
    assert choose(spark, [colour], {"color": "green"}) == ("fail", "candidate_required_value_missing", "color", None)
    assert choose(spark, [colour], {"size": "m"}) == ("unverifiable", "candidate_axis_missing", "size", None)
    assert choose(spark, [colour, ("颜色分类", [("x", "X", 1.0)])], {}) == ("unverifiable", "candidate_axis_collision", None, None)
    assert choose(spark, [colour, ("尺码", [("", "", 1.0)])], {}) == ("unverifiable", "candidate_axis_has_no_values", "size", None)
    assert choose(spark, [colour], None)[:2] == ("unverifiable", "missing_contract")
    assert choose(spark, [], {}) == ("pass", None, None, {})


def test_option_text_and_brand(spark):
    assert one(spark, options.option_text(F.col("x")), "x string", " Ａ／b C ") == "a|bc"
    assert one(spark, options.canonical_axis(options.option_text(F.col("x"))), "x string", "规 格描述") == "specification"
    brand = lambda *row: one(spark, options.explicit_brand(*map(F.col, "its"), {"huawei": ["华为"]}), "i string, t string, s string", *row)
    assert brand("买华为手机", "华为手机", "某店") == ["huawei"]
    assert brand("要小米官方的", "小米手机", "小米官方旗舰店") == ["小米"]
    assert brand("要手机", "小米手机", "小米旗舰店") == [] and brand("要手机", "手机", None) == []


def test_requirement_count(spark):
    count = options.requirement_count(*map(F.col, ("c", "a", "u", "b", "m")), F.col("p"))
    schema = "c array<string>, a array<string>, u array<string>, b array<string>, m array<string>, p double"
    assert tuple(one(spark, count, schema, ["x", " x", ""], ["Color", "color"], ["k"], [], ["m1"], 5.0)) == (1, 1, 1, 0, 1, 1, 5)
    assert one(spark, count, schema, None, None, None, None, None, None)["total"] == 0


@pytest.mark.parametrize("goal, bought, want", [
    ({"attributes": ["防水"]}, {"asin": None}, (True, False, "no_purchase", [])),
    ({}, {"asin": "1"}, (False, False, "requirements_empty", [])),
    ({"attributes": ["防水"]}, {"asin": "1", "text": ""}, (False, False, "purchase_evidence_missing", ["attribute:防水"])),
    ({"brands": ["飞利浦"], "reference": "1"}, {"asin": "1", "text": "philips灯"}, (True, True, None, [])),
    ({"options": ["红色"], "upper": 5.0}, {"asin": "1", "options": ["红"], "price": 6.0}, (True, False, "requirements_not_satisfied", ["price_upper"])),
    ({"options": ["红色"], "category": "灯"}, {"asin": "1", "options": ["", "蓝"], "category": "灯"}, (True, False, "requirements_not_satisfied", ["option:红色"])),
])
def test_verified_purchase(spark, goal, bought, want):
    kinds = {"reference": "string", "category": "string", "brands": "array<string>", "models": "array<string>", "attributes": "array<string>", "options": "array<string>", "upper": "double", "asin": "string", "text": "string", "price": "double"}
    lit = lambda v, k: (F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)).cast(kinds[k])
    g = {k: lit(goal.get(k), k) for k in ("reference", "category", "brands", "models", "attributes", "options", "upper")}
    b = {k: lit(bought.get(k), k) for k in ("asin", "category", "text", "options", "price")}
    r = spark.range(1).select(options.verified_purchase(g, b).alias("r")).first()["r"]
    assert (r["valid"], r["correct"], r["reason"], r["failed"]) == want
    assert r["type"] == ("gold_purchase" if want[1] else "unsuccessful_purchase")


SCHEMAS = {"open": {"type": "object", "properties": {"id": {"type": "string"}, "how": {"type": "string", "enum": ["a", "b"]}, "deep": {"type": "object", "required": ["n"], "properties": {"n": {"type": "number"}}}}, "required": ["id"], "additionalProperties": False}}


@pytest.mark.parametrize("arguments, want", [
    ('{"id": "1"}', None), ('{"id": "1", "how": "b", "deep": {"n": 1.5}}', None), ('{"id": "1", "deep": {"n": 2}}', None), (None, "schema_invalid"), ("{", "malformed_arguments"), ("[]", "malformed_arguments"),
    ('{"id": null}', "schema_invalid"), ('{"id": true}', "schema_invalid"), ('{"id": "1", "how": "c"}', "schema_invalid"), ('{"id": "1", "deep": {}}', "schema_invalid"), ('{"id": "1", "deep": {"n": "x"}}', "schema_invalid"), ('{"id": "1", "z": 1}', "schema_invalid"),
])
def test_format_of_arguments(spark, arguments, want):
    turn = ("assistant", None, [(("open", arguments),)])
    r = one(spark, messages.first_format_error(F.col("m"), F.lit(0), SCHEMAS), f"m {messages.MESSAGES}", [("user", "x", None), turn])
    assert (r and r["reason"]) == want


def test_format_of_turns(spark):
    good, error = ("assistant", None, [(("open", '{"id": "1"}'),)]), lambda m, cut=0: one(spark, messages.first_format_error(F.col("m"), F.col("n"), SCHEMAS), f"m {messages.MESSAGES}, n int", m, cut)
    assert tuple(error([])) == (0, "missing_tool_call") and tuple(error(None)) == (0, "missing_tool_call")
    assert tuple(error([good, ("assistant", "bye", None)])) == (1, "missing_tool_call")
    assert tuple(error([good, ("assistant", None, good[2] * 2)])) == (1, "multiple_tool_calls")
    assert tuple(error([("assistant", None, [(("shut", "{}"),)])])) == (0, "unknown_tool")
    assert error([good]) is None and tuple(error([good], 2)) == (0, "multiple_tool_calls")


def test_template_messages(spark):
    shown = F.to_json(messages.template_messages(F.col("m")))
    schema = f"m {messages.MESSAGES}"
    assert '"arguments":{"id":"1"}' in one(spark, shown, schema, [("user", "x", None), ("assistant", None, [(("open", '{"id": "1"}'),)])])
    assert one(spark, shown, schema, [("assistant", None, [(("open", "[1]"),)])]) is None


def test_instructions(spark):
    block = lambda x: one(spark, messages.instruction_block(F.col("x")), "x string", x)
    assert block("a Instruction: b\nc Instruction: d\n\n【初始页") == "b\nc Instruction: d"
    assert block("Instruction:  \n[SHOPPING_OBSERVATION_V2]") is None and block("none") is None and block(None) is None
    of = lambda *row: one(spark, messages.instruction_of(F.col("i"), F.col("m")), f"i string, m {messages.MESSAGES}", *row)
    assert of(" buy ", None) == "buy" and of(" ", [("user", " instruction: lamp ", None)]) == "lamp" and of(None, []) == ""


def test_json(spark):
    rows = spark.createDataFrame([('{"b": {"z": [1, null, "é"], "a": true}, "a": ""}',), ("{",), (None,)], "x string")
    got = rows.select(messages.canonical_json("x").alias("c"), messages.json_leaves("x").alias("l"), messages.nested(F.col("x"), "b", "a").alias("n"), messages.nested(F.col("x"), "b", "q").alias("q")).collect()
    assert tuple(got[0]) == ('{"a":"","b":{"a":true,"z":[1,null,"é"]}}', ["true", "1", "é"], "true", None)
    assert tuple(got[1]) == (None, ["{"], None, None) and tuple(got[2]) == (None, None, None, None)


def test_blind_projection(spark):
    df = spark.createDataFrame([(1, [({"k": (2, 3)},)])], "id int, e array<struct<m:map<string,struct<reward:int,x:int>>>>")
    assert collection.blind(df, ["id"], {"reward"}).columns == ["id"]
    with pytest.raises(ValueError, match="e.m.reward"):
        collection.blind(df, ["id", "e"], {"reward"})


def test_request_and_contract(spark):
    row = one(spark, collection.with_request(F.col("s"), {"difficulty_label": F.lit("easy"), "score": F.lit(1)}), "s struct<a:int,request:struct<difficulty_label:string,x:int>>", (1, ("hard", 2)))
    assert row.asDict(True) == {"a": 1, "request": {"difficulty_label": "easy", "x": 2, "score": 1}}
    differ = lambda *row: one(spark, collection.contract_mismatches(F.col("a"), F.col("b"), F.col("e")), "a map<string,string>, b map<string,string>, e boolean", *row)
    assert differ({"mode": "x", "top_p": "1"}, {"mode": "x", "top_p": "2", "thinking": None}, False) == []
    assert differ({"mode": "x", "top_p": "1"}, {"mode": "y", "top_p": "2"}, True) == ["mode", "top_p"]


def test_cache_and_ranks(spark):
    goals = spark.range(4).withColumnRenamed("id", "task_id")
    cache = spark.createDataFrame([(1, "v"), (1, "v"), (3, "v")], "task_id long, version string")
    assert sorted(r[0] for r in collection.pending(goals, cache, "task_id", "version", "v").collect()) == [0, 2]
    with pytest.raises(ValueError, match="other versions"):
        collection.pending(goals, cache, "task_id", "version", "w")
    hits = spark.createDataFrame([(1, 1), (9, 2), (2, 3)], "p int, rank int")
    assert sorted((r["rank"], r["name"]) for r in collection.ranked_products(hits, spark.createDataFrame([(2, "b"), (1, "a")], "p int, name string"), "p").collect()) == [(1, "a"), (3, "b")]


def test_batches(spark):
    rows = spark.createDataFrame([(1, True), (1, False), (2, None), (3, True), (4, True)], "b int, ok boolean")
    assert sorted(r["b"] for r in collection.collect_until(rows, "b", F.col("ok"), 2).collect()) == [1, 1, 2, 3]
    with pytest.raises(Exception, match="not finite"):
        collection.batch_metrics(rows, ["b"], F.lit(float("inf")), {}).collect()


def test_goals_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(collection, "RANGE", 2)
    products = spark.createDataFrame([(p, [([], 0), (["a"], 1), (["b"], 2)]) for p in (0, 1, 5, 7)] + [(3, None)], "p long, i array<struct<attributes:array<string>,k:int>>")
    got = sorted((r["task_id"], r["p"], r["goal"]["k"]) for r in collection.goals(products, "p", "i", "attributes").collect())
    assert got == [(n, p, k) for n, (p, k) in enumerate((p, k) for p in (0, 1, 5, 7) for k in (1, 2))]
