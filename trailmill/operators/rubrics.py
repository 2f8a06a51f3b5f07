"""Requirement assessments: one row for each assessed requirement of a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def status_counts(assessed: DataFrame, hardness: str, status: str) -> DataFrame:
    """AG22: assessments by hardness and status; a requirement without a known hardness counts as unknown."""
    return assessed.groupBy(F.coalesce(F.col(hardness), F.lit("unknown")).alias(hardness), status).agg(F.count("*").alias("n"))


def verdicts(assessed: DataFrame, key: str, requirement: str, hardness: str, status: str) -> DataFrame:
    """AG29, AG32: what the assessments of a record say, gathered once: violated requirements, hard ones among them, who is all satisfied."""
    applies = F.col(status) != "not_applicable"
    hard = F.coalesce(F.col(hardness) == "hard", F.lit(False))
    violated = F.col(status) == "violated"
    satisfied = F.col(status) == "satisfied"
    return assessed.groupBy(key).agg(
        F.sort_array(F.collect_set(F.when(violated, F.col(requirement)))).alias("violated"),
        F.count_if(violated & hard).alias("n_hard_violated"),
        F.coalesce(F.bool_and(F.when(applies & hard, satisfied)), F.lit(False)).alias("hard_satisfied"),
        F.coalesce(F.bool_and(F.when(applies, satisfied)), F.lit(False)).alias("all_satisfied"),
    )


def hard_violations(judged: Column, count: Column) -> Column:
    """AG32: null unless the judgment is valid."""
    return F.when(F.coalesce(judged, F.lit(False)), F.coalesce(count, F.lit(0)))


def disagreements(judged: Column, success: Column, reward_type: Column, violated: Column, n_hard: Column, hard_satisfied: Column, all_satisfied: Column) -> Column:
    """AG29: names of the rules by which the reward and the assessments contradict each other; none without a valid judgment."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    rules = [
        (success & (F.size(violated) > 0), "reward_success_with_rubric_violation"),
        (success & (n_hard > 0), "reward_success_with_hard_rubric_violation"),
        ((reward_type == "wrong_purchase") & hard_satisfied, "wrong_purchase_with_all_hard_rubrics_satisfied"),
        ((reward_type == "partial_alternative_purchase") & all_satisfied, "partial_reward_with_all_rubrics_satisfied"),
    ]
    return F.array_compact(F.array(*[F.when(yes(judged) & yes(rule), F.lit(name)) for rule, name in rules]))
