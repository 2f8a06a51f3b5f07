"""Literal cases of the numeral, review, masking and difficulty operators."""

import pytest
from pyspark.sql import functions as F

from trailmill.functions import numerals
from trailmill.operators import difficulty, reviews, sequence


def test_han_number(spark):
    cases = {"三": 3, "十二": 12, "两百零五": 205, "一千零一十": 1010, "三万二千": 32000, "万": 10000, "十万": 100000, "": None, "三x": None, "零": 0}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    got = {r[0]: r[1] for r in df.select("t", numerals.han_number(F.col("t"))).collect()}
    assert got == cases | {None: None}


def test_amounts(spark):
    df = spark.createDataFrame([("Box 500 G and 2kg",), ("30 cm",), ("",), (None,)], "t string")
    v = lambda *a, **k: [r[0] for r in df.select(numerals.amount_verdict(F.col("t"), *a, **k)).collect()]
    assert v("eq", 0.5, "kg") == ["pass", "unverifiable", "unverifiable", "unverifiable"]
    assert v("max", 400, "g") == ["fail", "unverifiable", "unverifiable", "unverifiable"]
    assert v("range", 1, "kg", upper=3)[0] == "pass" and v("min", 0.3, "m")[1] == "pass" and v("eq", 1, "oz")[0] == "unverifiable"
    with pytest.raises(ValueError):
        v("eq", 1, "g", tolerance=-1)


def test_spans(spark):
    df = spark.createDataFrame([("aXx.xxa",), ("",), (None,)], "t string")
    assert [r[0] and [tuple(s) for s in r[0]] for r in df.select(numerals.spans(F.col("t"), "xX")).collect()] == [[(1, 3), (4, 6)], [], None]
    assert [r[0] for r in df.select(numerals.spans(F.col("t"), "")).collect()] == [[], [], None]
    assert [tuple(s) for s in df.select(numerals.spans(F.col("t"), ".")).first()[0]] == [(3, 4)]


def test_cover_and_override(spark):
    need = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "g string, i int")
    have = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 9)], "g string, i int")
    assert {tuple(r) for r in reviews.exact_cover(need, have, "g", "i").collect()} == {("a", 1, 0, 1), ("b", 0, 1, 0)}
    p = spark.createDataFrame([(1, "x", "n"), (2, "y", "m")], "k int, v string, keep string")
    d = spark.createDataFrame([(2, "z")], "k int, v string")
    assert {tuple(r) for r in reviews.override(p, d, "k", ["v"]).collect()} == {(1, "x", "n", False), (2, "z", "m", True)}


def test_judged(spark):
    rows = spark.createDataFrame([(1, "partial", ["attribution:a", "b"]), (2, "final", ["attribution:a"]), (3, "partial", None), (4, "partial", ["attribution:c"])], "k int, status string, reasons array<string>")
    judge = spark.createDataFrame([(1, "fail", ["j"]), (2, "fail", ["j"]), (3, "pass", None)], "k int, status string, reasons array<string>")
    got = {r["k"]: (r["status"], r["reasons"]) for r in reviews.judged(rows, judge, "k", ("partial",), "attribution:").collect()}
    assert got == {1: ("fail", ["b", "j"]), 2: ("final", ["attribution:a"]), 3: ("pass", []), 4: ("partial", ["attribution:c"])}


def test_strata_targets():
    assert reviews.targets({"a": 10, "b": 1, "c": 10}, 3) == {"a": 4, "b": 1, "c": 4}
    with pytest.raises(ValueError):
        reviews.targets({"a": 1, "b": 1}, 2)


def test_label_masks(spark):
    m = spark.createDataFrame([(1, 0, "user", 2), (1, 1, "assistant", 3), (1, 2, None, 1)], "c int, t int, r string, n int")
    ranges = sequence.label_ranges(m, "c", "t", "r", "n").filter("keeps").groupBy("c").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    ids = ranges.select(sequence.mask_labels(F.array(*[F.lit(i) for i in range(10, 16)]), F.col("ranges")))
    assert ids.first()[0] == [-100, -100, 12, 13, 14, -100]


def test_logistic(spark):
    rows = [(i, float(i % 10), 1.0, int(i % 10 > 4)) for i in range(100)] + [(200, None, 1.0, 1), (201, 3.0, 1.0, None)]
    df = spark.createDataFrame(rows, "id long, x double, flat double, y int")
    s = difficulty.samples(df, "id", ["x", "flat"], "y", F.lit(True))
    assert s.count() == 100
    model, seen = difficulty.validated(s, "id", "id", ["x", "flat"], "y", "v")
    assert seen["accuracy"] == 1.0 and model.scales[1] == 1.0 and model.version == difficulty.fit(s, "id", ["x", "flat"], "y").version
    got = {r["id"]: r["difficulty"] for r in difficulty.scored(df, model).collect()}
    assert got[9] == "easy" and got[0] == "hard" and got[200] is None
    with pytest.raises(ValueError):
        difficulty.fit(s.filter("y = 1"), "id", ["x"], "y")
