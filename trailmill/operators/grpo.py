"""Group filters and advantages for groups of rollouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tolerance of equal rewards, least deviation, clip of advantages, penalty floors and the sampling marker.
TOLERANCE, LEAST_STD, CLIP = 1e-8, 0.1, 2.0
FLOORS = {"wrong_option": -0.25, "bad_buy": -0.5}
MARKER = 1e-4


def kept_groups(rollouts: DataFrame, group: str, utility: str, reward: str, valid: Column) -> DataFrame:
    """FLT15, AG15: groups of two valid members or more whose utility varies or differs from the reward."""
    v = rollouts.filter(valid)
    stats = v.groupBy(group).agg(
        F.count("*").alias("n_valid"), (F.max(utility) - F.min(utility)).alias("_range"), F.max(F.abs(F.col(reward) - F.col(utility))).alias("_gap"),
        F.min(utility).alias("_low"), F.max(utility).alias("_high"),
    )
    keep = (F.col("n_valid") >= 2) & ((F.col("_range") > TOLERANCE) | (F.col("_gap") > TOLERANCE))
    return stats.select(group, "n_valid", keep.alias("kept"), (F.col("_range") <= TOLERANCE).alias("all_equal"), (F.col("_high") == 0).alias("all_zero"))


def group_advantage(rollouts: DataFrame, group: str, score: str, valid: Column) -> DataFrame:
    """WIN8, AG16: (score - mean) / max(sample deviation, 0.1) over valid members, clipped to 2; 0 for invalid ones.

    A group with fewer than two valid members has no advantage (null): a violation.
    """
    w = Window.partitionBy(group)
    ok = F.when(valid, F.col(score))
    scaled = (F.col(score) - F.avg(ok).over(w)) / F.greatest(F.stddev_samp(ok).over(w), F.lit(LEAST_STD))
    clipped = F.greatest(F.least(scaled, F.lit(CLIP)), F.lit(-CLIP))
    return rollouts.withColumn("advantage", F.when(F.count(ok).over(w) < 2, F.lit(None).cast("double")).when(valid, clipped).otherwise(0.0))


def step_advantage(advantage: Column, penalty: Column, kind: Column, mask: Column) -> Column:
    """RWD9: advantage plus the step's penalty, at most the floor of its kind, clipped and masked."""
    total = advantage + F.coalesce(penalty, F.lit(0.0))
    floored = F.when(kind == "wrong_option", F.least(total, F.lit(FLOORS["wrong_option"]))).when(kind == "bad_buy", F.least(total, F.lit(FLOORS["bad_buy"]))).otherwise(total)
    return F.when(mask, F.greatest(F.least(floored, F.lit(CLIP)), F.lit(-CLIP))).otherwise(0.0)


def sampling_score(orm: Column, penalised: Column) -> Column:
    """RWD10: the outcome reward with a marker for any process penalty."""
    return orm + F.when(F.coalesce(penalised, F.lit(False)), F.lit(MARKER)).otherwise(0.0)


def advantage_summary(tokens: DataFrame, advantage: str, active: Column) -> DataFrame:
    """AG17: one row on the active tokens' advantages; zeros where no token is active."""
    x = F.when(active, F.col(advantage))
    share = lambda c: F.avg(F.when(x.isNotNull(), c.cast("double")))
    parts = {
        "mean": F.avg(x), "std": F.stddev_pop(x), "min": F.min(x), "max": F.max(x), "positive_ratio": share(x > 0), "negative_ratio": share(x < 0),
        "zero_ratio": share(x == 0), "clip_ratio": share(F.abs(x) >= CLIP - 1e-6),
    }
    return tokens.agg(*[F.coalesce(c, F.lit(0.0)).alias(n) for n, c in parts.items()])
