"""Requirements: literal requests and rubrics, an environment's checks, and re-audits against fresh ones."""

import json

import pytest
from pyspark.sql import functions as F

from trailmill.functions import numerals, prices, signals
from trailmill.operators import requirements

CUP = "请购买50元以内的白色保温杯"


def facts(text):
    return [(b["operator"], b["priority"], b["value"] if b["low"] is None else (b["low"], b["high"]), b["text"]) for b in signals.signals_of(text)["budgets"]]


@pytest.mark.parametrize("text, want", [
    ("请买50元以内的白色保温杯", [("lte", "hard", 50, "50元以内")]), ("价格在20元左右", [("approx", "soft", 20, "20元左右")]),
    ("直径17.5cm，容量180毫升，预算70元左右", [("approx", "soft", 70, "70元左右")]), ("预算在100-200元，尺寸23厘米左右", [("between", "hard", (100, 200), "100-200元")]),
    ("300元到 200 块钱", [("between", "hard", (200, 300), "300元到 200 块钱")]), ("预算控制在不超过3千", [("lte", "hard", 3000, "预算控制在不超过3千")]),
    ("心里价格大概1.5万 左右吧", [("approx", "soft", 15000, "心里价格大概1.5万 左右")]), ("两百五十块以内", [("lte", "hard", 250, "两百五十块以内")]), ("一千多元", [("approx", "soft", 1000, "一千多元")]),
    ("最好别超过80元", [("lte", "soft", 80, "80元")]), ("80元", [("approx", "soft", 80, "80元")]), ("80元以上", [("approx", "soft", 80, "80元以上")]), ("价格好", []), ("", []), ("预算价格9", [("approx", "soft", 9, "价格9")]),
    ("预算100到200", [("approx", "soft", 100, "预算100")]), ("价格50元，价格60元", [("approx", "soft", 50, "50元"), ("approx", "soft", 60, "60元")]),
])
def test_budgets(text, want):
    assert facts(text) == want


def test_signals(spark):
    rows = spark.createDataFrame([(" 必须 3KG以上，不要糖，最好2 瓶 ",), (None,), ("",)], "t string").select(signals.signals(F.col("t")).alias("s")).select("s.*").collect()
    assert [tuple(a) for a in rows[0]["amounts"]] == [("3KG以上", 3.0, "KG", "以上", 3, 8), ("2 瓶", 2.0, "瓶", None, 15, 18)]
    assert [m["text"] for m in rows[0]["hard"]] == ["必须", "不要", "要"] and [m["text"] for m in rows[0]["soft"]] == ["最好"]
    assert [tuple(m) for m in rows[0]["negative"]] == [("不要", 9, 11)]
    assert list(rows[1]) == [None] * 5 and list(rows[2]) == [[]] * 5
    assert len(facts("价格5元，" * 20_000)) == 20_000
    assert [signals.han_value(x) for x in ("三百零五", "十", "两万三千", "万", "二十三")] == [305, 10, 23000, 10000, 23]


def test_places(spark):
    one = lambda t, v: [tuple(s) for s in spark.createDataFrame([(t, v)], "t string, v string").select(numerals.places(F.col("t"), F.col("v"))).first()[0]]
    assert one("A+b a+B", "a+b") == [(0, 3), (4, 7)] and one("aaa", "aa") == [(0, 2)] and one("a\\Eb.", "\\E") == [(1, 3)]
    assert one("abc", "") == [] == one("abc", None) and one("a.c", "x") == []


TASK = "k int, q string, cat string, brands array<string>, models array<string>, fns array<string>, opts array<struct<axis:string,source_axis:string,value:string>>, loose array<string>"


def test_candidates(spark):
    rows = [
        (1, "要小米手机，红色，3000元以内，3000元以内", "数码›手机", ["小米", " 小米 "], ["K70", None], ["快充", ""], [("color", "颜色", "红色"), ("color", "颜色", "红色"), ("size", None, " L  码 ")], ["蓝"]),
        (2, None, None, None, None, None, None, ["蓝", "蓝"]), (3, "", "", [], [], [], [], ["绿"]),
    ]
    tasks = spark.createDataFrame(rows, TASK).withColumn("p", prices.candidates(F.col("q")))
    got = requirements.requirement_candidates(tasks, "k", "q", "cat", "brands", "models", "fns", "opts", "loose", "p").orderBy("k", "candidate_id").collect()
    plain = [(r["k"], r["candidate_id"], r["constraint_type"], r["field_path"], r["expected_value"], [tuple(s) for s in r["spans"]]) for r in got]
    assert plain == [
        (1, "c0001", "category", "product.category", "数码›手机", [(3, 5)]), (1, "c0002", "brand", "product.brand", "小米", [(1, 3)]), (1, "c0003", "model", "product.model", "K70", []),
        (1, "c0004", "core_function", "product.attributes", "快充", []), (1, "c0005", "option", "purchase.options.color", "红色", [(6, 8)]), (1, "c0006", "option", "purchase.options.size", "L 码", []),
        (1, "c0007", "budget_upper", "purchase.price", None, [(9, 16)]), (2, "c0001", "option", "purchase.options.unresolved", "蓝", []),
    ]
    assert [r["description_hint"] for r in got] == ["商品品类应为手机", "品牌应为小米", "型号应为K70", "商品应支持快充", "颜色应选择红色", "size应选择L 码", "价格不应超过3000元", "规格应包含蓝"]
    assert got[6]["high"] == 3000 and got[6]["operator"] == "lte" and len({r["identity"] for r in got}) == 8
    assert requirements.requirement_candidates(tasks.limit(0), "k", "q", "cat", "brands", "models", "fns", "opts", "loose", "p").count() == 0


CHECKS = "k int, said string, event string, checks array<struct<name:string,required:array<string>,actual:string,verifiable:boolean,passed:boolean>>"


def test_check_requirements(spark):
    rows = [
        (1, "要 Ｒed Cup，大 号", "E9", [("brand:x", ["re d", "z"], "red", True, True), ("price_upper", None, "3", True, None), None, ("category", ["nope", "大号\n"], None, None, True), ("", ["-"], None, True, False), ("option:a", [None, " "], "b", False, None)]),
        (2, None, None, [("model:m", ["x"], None, True, True)]), (3, "x", "", None), (4, " ", "", [("attribute:m", ["-"], None, True, True)]),
    ]
    made = requirements.check_requirements(spark.createDataFrame(rows, CHECKS), "k", "checks", "said", "event")
    got = [tuple(r) for r in made.orderBy("k", "requirement_id").select("k", "requirement_id", "name", "type", "status", "query_evidence", "eligible", "evidence_event_ids").collect()]
    assert got == [
        (1, "R001", "brand:x", "brand", "satisfied", "re d", True, ["E9"]), (1, "R002", "price_upper", "budget", "violated", None, False, ["E9"]), (1, "R004", "category", "category", "unknown", "大号", True, ["E9"]),
        (1, "R005", "requirement:5", "other", "violated", "-", True, ["E9"]), (1, "R006", "option:a", "option", "unknown", None, False, ["E9"]),
        (2, "R001", "model:m", "model", "satisfied", None, False, []), (4, "R001", "attribute:m", "attribute", "satisfied", None, False, []),
    ]
    assert {r["k"]: tuple(r)[1:] for r in requirements.requirement_counts(made, "k").collect()} == {1: (1, 2, 2, 0, 0), 2: (1, 0, 0, 0, 0), 4: (1, 0, 0, 0, 0)}


def item(requirement="价格不超过50元", kind="budget", evidence="50元以内", priority="hard", **verifier):
    return {"requirement": requirement, "type": kind, "priority": priority, "query_evidence": evidence, "verifier": {"kind": "deterministic", "field": "price", "operator": "lte", "value": 50} | verifier}


WHITE = item("颜色为白色", "option", "白色", field="option", operator="option_match", value="白色")
SEMANTIC = {"kind": "semantic", "operator": "semantic_entailment", "criterion": "c"}


def audit(spark, said, rubric):
    text = rubric if rubric is None or isinstance(rubric, str) else json.dumps(rubric, ensure_ascii=False)
    return requirements.audited(spark.createDataFrame([(7, said, text)], "k int, said string, raw string"), "said", "raw").first()


@pytest.mark.parametrize("said, rubric, reasons", [
    (CUP, {"items": [WHITE, item()]}, []),
    (CUP, {"items": [WHITE | {"query_evidence": "红色"}, item()]}, ["R001:query_evidence_not_exact"]),
    (CUP, {"items": [item()], "review_required": True}, ["llm_marked_review_without_reason"]), (CUP, {"items": [item()], "review_required": True, "review_reasons": [" a ", "a", "", "b"]}, ["a", "b"]),
    (CUP, {"items": [item()], "review_reasons": "a"}, ["llm_review_reasons_not_array"]), (CUP, {"items": [item()], "review_required": "true"}, []),
    (CUP, {"items": [WHITE]}, ["budget_rule_conflict:1"]), (CUP, {"items": [item(value=49)]}, ["budget_rule_conflict:1"]), (CUP, {"items": [item(value="50元")]}, []), (CUP, {"items": [item(operator="<=")]}, []), (CUP, {"items": [item(operator="gte")]}, ["budget_rule_conflict:1"]),
    (CUP, {"items": [item(), item(" 价格 不超过50元 ")]}, ["duplicate_requirements:R001:R002"]), (CUP, {"items": [item(), WHITE, item(), item()]}, ["duplicate_requirements:R001:R003", "duplicate_requirements:R001:R004"]),
    (CUP, {"items": [item(), item("b", "other", "白色", operator="near")]}, ["R002:unsupported_operator:near"]), (CUP, {"items": [item(), item("b", "other", "白色", operator="")]}, ["R002:unsupported_operator:empty"]),
    (CUP, {"items": [item(), item("b", "other", "白色", value=True)]}, ["R002:numeric_value_unusable"]), (CUP, {"items": [item(), item("b", "other", "白", value="10")]}, ["R002:query_evidence_too_short"]),
    ("请购买40-50元的白色保温杯", {"items": [item(evidence="40-50元", operator="range", value="40-50元")]}, []), ("请购买40-50元的白色保温杯", {"items": [item(evidence="40-50元", operator="between", value={"max": 40, "minimum": "50"})]}, []),
])
def test_audit_reasons(spark, said, rubric, reasons):
    got = audit(spark, said, rubric)
    assert (got["fault"], got["reasons"], got["review"]) == (None, reasons, bool(reasons))


def test_audit_items(spark):
    no_value = item("b", "other", "白色", field="")
    del no_value["verifier"]["value"]
    got = audit(spark, "请购买40-50元的白色保温杯", {"items": [item(evidence="红", operator="approx", value="50到40"), no_value, item("c", "other", "白色") | {"verifier": SEMANTIC | {"field": "f"}}, item("d", "other", "白色", operator="equals", value=None)]})
    a, b, c, d = got["items"]
    assert (a["operator"], tuple(a["number"]), a["query_evidence"]) == ("between", (None, 40, 50), "请购买40-50元的白色保温杯")
    assert (b["kind"], b["field"], b["operator"], b["criterion"], b["number"]) == ("semantic", "product", "semantic_entailment", "b", None)
    assert (c["kind"], c["field"], c["criterion"], d["kind"], d["value"]) == ("semantic", "f", "c", "deterministic", "null")
    assert got["reasons"] == ["R001:query_evidence_not_exact", "R002:deterministic_value_missing"]


@pytest.mark.parametrize("said, rubric, fault", [
    (" ", {"items": [item()]}, "request_empty"), (None, {"items": [item()]}, "request_empty"), (CUP, None, "rubric_not_object"), (CUP, "{", "rubric_not_object"), (CUP, "[1]", "rubric_not_object"), (CUP, "null", "rubric_not_object"),
    (CUP, {"items": []}, "items_missing"), (CUP, {"items": "x"}, "items_missing"), (CUP, {}, "items_missing"), (CUP, {"items": [item()] * 31}, "too_many_items"), (CUP, {"items": [item(), 3]}, "R002:item_not_object"), (CUP, {"items": [None]}, "R001:item_not_object"),
    (CUP, {"items": [item("")]}, "R001:requirement_or_evidence_missing"), (CUP, {"items": [item(kind="x")]}, "R001:type_or_priority_unknown"), (CUP, {"items": [item(priority="x")]}, "R001:type_or_priority_unknown"), (CUP, {"items": [item() | {"verifier": 3}]}, "R001:verifier_kind_unknown"),
    (CUP, {"items": [item() | {"verifier": SEMANTIC | {"criterion": " "}}]}, "R001:semantic_verifier_incomplete"), (CUP, {"items": [item(field=" ")]}, "R001:verifier_field_empty"), (CUP, {"items": [item() | {"verifier": SEMANTIC}]}, "R001:verifier_field_empty"),
])
def test_audit_faults(spark, said, rubric, fault):
    got = audit(spark, said, rubric)
    assert (got["fault"], got["items"], got["reasons"], got["review"]) == (fault, None, None, None)


def test_reaudit(spark):
    good, bad = json.dumps({"items": [item()]}), json.dumps({"items": []})
    stored = spark.createDataFrame([(1, good, ["old"], 5), (2, bad, None, 5), (3, good, None, 5), (None, good, None, 5)], "k int, raw string, reasons array<string>, tries int")
    asked = spark.createDataFrame([(1, CUP), (2, CUP)], "k int, said string")
    got = requirements.reaudited(stored, asked, "k", "said", "raw").collect()
    assert [(r["k"], r["reasons"], r["tries"], r["items"][0]["number"]["value"]) for r in got] == [(1, [], 5, 50)]
    assert requirements.reaudited(stored.limit(0), asked, "k", "said", "raw").count() == 0
    with pytest.raises(ValueError, match="_items"):
        requirements.audited(stored.withColumn("_items", F.lit(1)), "raw", "raw")
