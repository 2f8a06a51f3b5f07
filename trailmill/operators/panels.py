"""Summary panels over expected ids, pairs of runs and distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fixed_denominator(expected: DataFrame, results: DataFrame, key: str, strata: str, flags: list[str]) -> DataFrame:
    """AG2, AG3: rates over expected ids, missing results counting 0; by stratum and overall (stratum 'all')."""
    joined = expected.join(results, key, "left")
    counts = [F.sum(F.coalesce(F.col(f), F.lit(False)).cast("long")).alias(f"n_{f}") for f in flags]
    out = joined.rollup(strata).agg(F.grouping_id().alias("_g"), F.count("*").alias("n_expected"), *counts)
    rates = [F.round(F.try_divide(F.col(f"n_{f}"), F.col("n_expected")), 6).alias(f"rate_{f}") for f in flags]
    return out.select(F.when(F.col("_g") == 1, "all").otherwise(F.col(strata)).alias("stratum"), "n_expected", *[f"n_{f}" for f in flags], *rates)


def distribution(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """AG5, AG6, AG7: count, min, median, mean, nearest-rank p90 and p95, interpolated p30, max."""
    return df.groupBy(*key).agg(
        F.count(value).alias("n"), F.min(value).alias("low"), F.round(F.median(value), 6).alias("median"), F.round(F.avg(value), 6).alias("mean"),
        F.expr(f"percentile_disc(0.9) WITHIN GROUP (ORDER BY {value})").alias("p90"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95"),
        F.round(F.expr(f"percentile_cont(0.3) WITHIN GROUP (ORDER BY {value})"), 6).alias("p30"), F.max(value).alias("high"),
    )


def transitions(base: DataFrame, candidate: DataFrame, key: str, success: str) -> DataFrame:
    """JN6, AG21: gained, lost, both, neither and unpaired counts of two runs."""
    a, b = base.select(key, F.col(success).alias("a")), candidate.select(key, F.col(success).alias("b"))
    kind = F.when(F.col("a").isNull() | F.col("b").isNull(), "unpaired").when(F.col("a") & F.col("b"), "both").when(F.col("a"), "lost").when(F.col("b"), "gained").otherwise("neither")
    return a.join(b, key, "full_outer").groupBy(kind.alias("transition")).agg(F.count("*").alias("n"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """AG8: counts by a, by b and by both in one pass."""
    sets = df.groupingSets([[a], [b], [a, b]], a, b)
    return sets.agg(F.grouping_id().cast("long").alias("panel"), F.count("*").alias("n")).select(F.coalesce(F.col(a), F.lit("*")).alias(a), F.coalesce(F.col(b), F.lit("*")).alias(b), "panel", "n")


def deltas(pairs: DataFrame, key: list[str], before: Column, after: Column) -> DataFrame:
    """AG20: pairs, mean change, improved, unchanged, worsened."""
    d = after - before
    return pairs.withColumn("_d", d).groupBy(*key).agg(
        F.count("_d").alias("n"), F.round(F.avg("_d"), 6).alias("mean_delta"),
        F.sum((F.col("_d") > 0).cast("long")).alias("improved"), F.sum((F.col("_d") == 0).cast("long")).alias("unchanged"), F.sum((F.col("_d") < 0).cast("long")).alias("worsened"),
    )
