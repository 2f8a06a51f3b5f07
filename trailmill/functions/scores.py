"""Difficulty, reward and comparison scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def complexity(a: Column, a95: Column) -> Column:
    """MTH1, MTH3: min(1, ln(1 + a) / ln(1 + a95)); with a95 <= 0 it is 1 for any a above 0."""
    return F.when(a95 <= 0, (a > 0).cast("double")).otherwise(F.least(F.lit(1.0), F.log1p(a) / F.log1p(a95)))


def rank_difficulty(rank: Column) -> Column:
    """MTH2: ln(1 + min(rank - 1, 20)) / ln 21; no rank counts as 21."""
    return F.log1p(F.least(F.coalesce(rank, F.lit(21)) - 1, F.lit(20))) / F.log(F.lit(21.0))


def preliminary(c: Column, r: Column, n: Column) -> Column:
    """MTH4."""
    return 0.45 * c + 0.35 * r + 0.2 * n


def sigmoid(z: Column) -> Column:
    """MTH5, stable on both sides."""
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def difficulty_label(p: Column) -> Column:
    """MLR2."""
    return F.when(p >= 0.75, "easy").when(p >= 0.35, "medium").otherwise("hard")


def length_bucket(steps: Column) -> Column:
    """SMP12."""
    return F.when(steps.between(3, 10), "short").when(steps.between(11, 20), "medium").when(steps.between(21, 35), "long").otherwise("outside")


def tri_state(verifiable: Column, passed: Column) -> Column:
    """RWD1: pass, fail or unverifiable; the last is no null and no failure."""
    return F.when(~F.coalesce(verifiable, F.lit(False)), "unverifiable").when(F.coalesce(passed, F.lit(False)), "pass").otherwise("fail")


def purchase_reward(category: Column, budget: Column, gold: Column, match: Column, coverage: Column) -> Column:
    """RWD5, RWD6: gates, then gold 1, alternative 0.55, partial min(0.25, -0.30 + 0.55 match)."""
    return (
        F.when((category == "unverifiable") | (budget == "unverifiable"), 0.0)
        .when((category == "fail") | (budget == "fail"), -0.85)
        .when(gold, 1.0)
        .when((match >= 0.7) & (coverage >= 0.75), 0.55)
        .otherwise(F.least(F.lit(0.25), -0.30 + 0.55 * match))
    )


def outcome_reward(invalid: Column, purchased: Column, category_ok: Column, gold: Column, attributes: Column, options: Column, price: Column) -> Column:
    """RWD7: null if invalid, -0.25 without a purchase, -0.5 in a wrong category, 1 for gold, else half the product of the ratios."""
    return F.when(invalid, F.lit(None).cast("double")).when(~purchased, -0.25).when(~category_ok, -0.5).when(gold, 1.0).otherwise(0.5 * attributes * options * price)


def combined_ratio(passed: Column, required: Column) -> Column:
    """AG25: passed / required; 1 if nothing is required."""
    return F.coalesce(F.try_divide(passed, required), F.lit(1.0))


def finite(x: Column) -> Column:
    """MTH9: null for what is no finite number."""
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(x)


def fingerprint(*parts: Column) -> Column:
    """MTH7: a hash of ordered parts."""
    return F.sha2(F.concat_ws("\x00", *parts), 256)


def budget_gate(upper: Column, resolved: Column, price: Column) -> Column:
    """RWD17: pass without a budget; unverifiable without a resolved, finite price of 0 or more or a finite budget above 0; else price <= budget."""
    known = F.coalesce(resolved, F.lit(False)) & F.coalesce(finite(price) >= 0, F.lit(False)) & F.coalesce(finite(upper) > 0, F.lit(False))
    return F.when(upper.isNull(), "pass").when(~known, "unverifiable").when(price <= upper, "pass").otherwise("fail")
