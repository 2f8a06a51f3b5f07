"""Queries of requirement assessments, advantages by token, first sights and budgets over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores
from ..operators import grpo, rubrics, sequence
from .queries import query, t

#: Lines stand for assessed requirements, by expressions that both engines have.
HARDNESS = "CASE l_suppkey % 4 WHEN 0 THEN 'hard' WHEN 1 THEN NULL ELSE 'soft' END"
STATUS = "CASE l_partkey % 9 WHEN 0 THEN 'violated' WHEN 1 THEN 'not_applicable' WHEN 2 THEN 'unknown' ELSE 'satisfied' END"
OUTCOME = "CASE o_orderkey % 5 WHEN 0 THEN 'gold_purchase' WHEN 1 THEN 'wrong_purchase' WHEN 2 THEN 'partial_alternative_purchase' END"
_ASSESSED = f"assessed AS (SELECT l_orderkey, l_linenumber, {HARDNESS} AS hardness, {STATUS} AS status FROM lineitem)"


def assessed(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(HARDNESS).alias("hardness"), F.expr(STATUS).alias("status"))


@query(f"WITH {_ASSESSED} SELECT coalesce(hardness, 'unknown') AS hardness, status, count(*)::BIGINT AS n FROM assessed GROUP BY 1, 2")
def requirement_status_counts(spark, sf_dir):
    return rubrics.status_counts(assessed(spark, sf_dir), "hardness", "status")


@query(f"""WITH {_ASSESSED}, r AS (SELECT o_orderkey, {OUTCOME} AS outcome, a.* FROM orders LEFT JOIN assessed a ON l_orderkey = o_orderkey WHERE o_orderkey % 11 <> 0),
g AS (SELECT o_orderkey, any_value(outcome) AS outcome, coalesce(array_to_string(list_sort(list(DISTINCT l_linenumber) FILTER (status = 'violated')), ','), '') AS violated,
  count(*) FILTER (status = 'violated') AS v, count(*) FILTER (status = 'violated' AND hardness = 'hard') AS h,
  count(*) FILTER (hardness = 'hard' AND status <> 'not_applicable') AS hard, count(*) FILTER (hardness = 'hard' AND status = 'satisfied') AS hard_ok,
  count(*) FILTER (status <> 'not_applicable') AS n_applies, count(*) FILTER (status = 'satisfied') AS n_ok FROM r GROUP BY 1)
SELECT o.o_orderkey, CASE WHEN g.o_orderkey IS NOT NULL THEN h END::BIGINT AS hard_violations, coalesce(violated, '') AS violated,
  concat_ws(',', CASE WHEN outcome = 'gold_purchase' AND v > 0 THEN 'reward_success_with_rubric_violation' END, CASE WHEN outcome = 'gold_purchase' AND h > 0 THEN 'reward_success_with_hard_rubric_violation' END,
    CASE WHEN outcome = 'wrong_purchase' AND hard > 0 AND hard = hard_ok THEN 'wrong_purchase_with_all_hard_rubrics_satisfied' END,
    CASE WHEN outcome = 'partial_alternative_purchase' AND n_applies > 0 AND n_applies = n_ok THEN 'partial_reward_with_all_rubrics_satisfied' END) AS reasons
FROM orders o LEFT JOIN g USING (o_orderkey)""")
def reward_rubric_disagreement(spark, sf_dir):
    """AG29, AG32: every eleventh order has no valid judgment."""
    said = rubrics.verdicts(assessed(spark, sf_dir), "l_orderkey", "l_linenumber", "hardness", "status")
    o = t(spark, sf_dir, "orders").select("o_orderkey", F.expr(OUTCOME).alias("outcome")).join(said, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    judged = F.col("o_orderkey") % 11 != 0
    reasons = rubrics.disagreements(judged, F.col("outcome") == "gold_purchase", F.col("outcome"), F.col("violated"), F.col("n_hard_violated"), F.col("hard_satisfied"), F.col("all_satisfied"))
    shown = F.when(judged, F.array_join(F.col("violated").cast("array<string>"), ","))
    return o.select("o_orderkey", rubrics.hard_violations(judged, F.col("n_hard_violated")).alias("hard_violations"), F.coalesce(shown, F.lit("")).alias("violated"), F.array_join(reasons, ",").alias("reasons"))


_X = "greatest(-2.0::DOUBLE, least(2.0::DOUBLE, (l_quantity::DOUBLE - 25) / 10))"
_S = ", ".join(f"round(coalesce({e}, 0), 6)::DOUBLE AS {n}" for n, e in {
    "mean": "avg(x)", "std": "stddev_pop(x)", "min": "min(x)", "max": "max(x)", "positive_ratio": "avg((x > 0)::INT)", "negative_ratio": "avg((x < 0)::INT)",
    "zero_ratio": "avg((x = 0)::INT)", "clip_ratio": "avg((abs(x) >= 1.999999)::INT)"}.items())


@query(f"SELECT {_S} FROM (SELECT {_X} AS x FROM lineitem WHERE l_linenumber % 3 <> 0)")
def token_advantage_summary(spark, sf_dir):
    x = F.greatest(F.lit(-2.0), F.least(F.lit(2.0), (F.col("l_quantity").cast("double") - 25) / 10))
    got = grpo.advantage_summary(t(spark, sf_dir, "lineitem").select(x.alias("x"), "l_linenumber"), "x", F.col("l_linenumber") % 3 != 0)
    return got.select(*[F.round(c, 6).alias(c) for c in got.columns])


@query("""SELECT l_suppkey, l_linenumber, count(DISTINCT l_partkey) FILTER (l_linenumber = seen)::BIGINT AS n_new
FROM (SELECT *, min(l_linenumber) OVER (PARTITION BY l_suppkey, l_partkey) AS seen FROM lineitem) GROUP BY 1, 2""")
def new_items_per_step(spark, sf_dir):
    return sequence.new_ids(t(spark, sf_dir, "lineitem"), "l_suppkey", "l_linenumber", "l_partkey")


_UPPER = "CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 9 = 1 THEN CAST(0 AS DOUBLE) ELSE CAST(200000 AS DOUBLE) END"
_PRICE = "CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_totalprice AS DOUBLE) END"


@query(f"""WITH b AS (SELECT o_orderkey, {_UPPER} AS upper, {_PRICE} AS price, o_orderkey % 7 <> 0 AS resolved FROM orders)
SELECT o_orderkey, CASE WHEN upper IS NULL THEN 'pass' WHEN NOT resolved OR price IS NULL OR price < 0 OR upper <= 0 THEN 'unverifiable' WHEN price <= upper THEN 'pass' ELSE 'fail' END AS gate FROM b""")
def budget_gates(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", scores.budget_gate(F.expr(_UPPER), F.expr("o_orderkey % 7 <> 0"), F.expr(_PRICE)).alias("gate"))
