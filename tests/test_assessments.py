"""Literal answers of assessments, token advantages, first sights and budgets."""

from pyspark.sql import functions as F

from trailmill.functions import scores
from trailmill.operators import grpo, rubrics, sequence


def test_disagreements_by_rule(spark):
    rows = [
        ("a", "r1", "hard", "violated"), ("a", "r2", "soft", "violated"), ("a", "r3", None, "satisfied"), ("b", "r1", "hard", "satisfied"), ("b", "r2", "soft", "violated"),
        ("c", "r1", "soft", "satisfied"), ("c", "r2", "hard", "not_applicable"), ("d", "r1", "hard", "violated"), ("e", "r1", "hard", "not_applicable"),
    ]
    said = rubrics.verdicts(spark.createDataFrame(rows, "k string, id string, hardness string, status string"), "k", "id", "hardness", "status")
    outcome = [("a", "gold", True, True), ("b", "wrong_purchase", False, True), ("c", "partial_alternative_purchase", False, True), ("d", "gold", True, False), ("e", "wrong_purchase", False, True), ("f", "gold", True, True)]
    o = spark.createDataFrame(outcome, "k string, type string, success boolean, judged boolean").join(said, "k", "left")
    reasons = rubrics.disagreements(*[F.col(c) for c in ("judged", "success", "type", "violated", "n_hard_violated", "hard_satisfied", "all_satisfied")])
    got = {r.k: (r.reasons, r.n) for r in o.select("k", reasons.alias("reasons"), rubrics.hard_violations(F.col("judged"), F.col("n_hard_violated")).alias("n")).collect()}
    assert got == {
        "a": (["reward_success_with_rubric_violation", "reward_success_with_hard_rubric_violation"], 1), "b": (["wrong_purchase_with_all_hard_rubrics_satisfied"], 0),
        "c": (["partial_reward_with_all_rubrics_satisfied"], 0), "d": ([], None), "e": ([], 0), "f": ([], 0),
    }


def test_advantage_summary(spark):
    df = spark.createDataFrame([(2.0, True), (-1.0, True), (0.0, True), (1.0, True), (50.0, False), (None, True)], "x double, on boolean")
    r = grpo.advantage_summary(df, "x", F.col("on")).first().asDict()
    assert {k: round(v, 6) for k, v in r.items()} == {"mean": 0.5, "std": 1.118034, "min": -1.0, "max": 2.0, "positive_ratio": 0.5, "negative_ratio": 0.25, "zero_ratio": 0.25, "clip_ratio": 0.25}
    assert set(grpo.advantage_summary(df.limit(0), "x", F.col("on")).first()) == {0.0}


def test_new_ids(spark):
    df = spark.createDataFrame([("s", 1, "a"), ("s", 1, "b"), ("s", 2, "a"), ("s", 3, "c"), ("s", 3, "c"), ("t", 2, "a"), ("t", 5, None)], "s string, n int, i string")
    assert {tuple(r) for r in sequence.new_ids(df, "s", "n", "i").collect()} == {("s", 1, 2), ("s", 2, 0), ("s", 3, 1), ("t", 2, 1), ("t", 5, 0)}


def test_budget_gate(spark):
    inf = float("inf")
    rows = [(None, False, None, "pass"), (5.0, True, 5.0, "pass"), (5.0, True, 5.01, "fail"), (5.0, False, 1.0, "unverifiable"), (5.0, None, 1.0, "unverifiable"), (5.0, True, None, "unverifiable"),
            (5.0, True, -1.0, "unverifiable"), (0.0, True, 0.0, "unverifiable"), (inf, True, 1.0, "unverifiable"), (5.0, True, float("nan"), "unverifiable")]
    df = spark.createDataFrame(rows, "upper double, ok boolean, price double, want string")
    assert df.filter(scores.budget_gate(F.col("upper"), F.col("ok"), F.col("price")) != F.col("want")).count() == 0
