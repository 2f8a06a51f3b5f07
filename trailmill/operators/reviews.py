"""Reviews that change or cover proposals: exact cover, overrides, strata for a gold set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import dealt
from . import sampling


def exact_cover(required: DataFrame, given: DataFrame, group: str, item: str) -> DataFrame:
    """JN17: by group, required items that are missing, given ones not required, and items given twice or more.

    Both sides are dealt by group once, to tasks of bounded input, and counted side by side there; nothing is joined.
    A null group or item is never the same as another side's.
    """
    side = lambda df, want: df.select(group, item, F.lit(want).alias("_want"), F.when(F.col(group).isNull() | F.col(item).isNull(), want).alias("_apart"))
    rows = dealt(side(required, 1).unionByName(side(given, 0)), group)
    each = rows.groupBy(group, item, "_apart").agg(F.max("_want").alias("_want"), F.count(F.when(F.col("_want") == 0, 1)).alias("_have"))
    n = lambda c: F.sum(c.cast("long"))
    return each.groupBy(group).agg(n(F.col("_have") == 0).alias("n_missing"), n(F.col("_want") == 0).alias("n_unexpected"), n(F.col("_have") > 1).alias("n_repeated"))


def override(proposals: DataFrame, decisions: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """JN18: decided values in place of proposed ones; `decided` tells which. Decisions hold a key once."""
    d = decisions.select(key, F.lit(True).alias("_decided"), *[F.col(c).alias(f"_{c}") for c in columns])
    out = proposals.join(d, key, "left").withColumn("decided", F.coalesce("_decided", F.lit(False)))
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"_{c}", c))
    return out.select(*proposals.columns, "decided")


def judged(rows: DataFrame, judge: DataFrame, key: str, open_states: tuple[str, ...], prefix: str) -> DataFrame:
    """JN21: the judge's status and reasons where a row's own status is open; reasons with the prefix give way."""
    j = judge.select(key, F.col("status").alias("_status"), F.col("reasons").alias("_reasons"))
    use = F.col("status").isin(*open_states) & F.col("_status").isNotNull()
    kept = F.filter(F.coalesce("reasons", F.array().cast("array<string>")), lambda r: ~r.startswith(prefix))
    out = rows.join(j, key, "left")
    return out.select(*[F.col(c) for c in rows.columns if c not in ("status", "reasons")],
                      F.when(use, F.concat(kept, F.coalesce("_reasons", F.array().cast("array<string>")))).otherwise(F.col("reasons")).alias("reasons"),
                      F.when(use, F.col("_status")).otherwise(F.col("status")).alias("status"))


def transition(before: Column, after: Column) -> Column:
    """SMP11: the stratum of a pair of outcomes; null counts as failure."""
    b, a = F.coalesce(before, F.lit(False)), F.coalesce(after, F.lit(False))
    return F.when(b & a, "both_success").when(b, "base_only_success").when(a, "candidate_only_success").otherwise("both_failure")


def targets(sizes: dict[str, int], each: int) -> dict[str, int]:
    """SMP11: as many of each stratum; what a small one lacks goes, one by one, to the one with most rows left."""
    out = {s: min(each, n) for s, n in sizes.items()}
    for _ in range(each * len(sizes) - sum(out.values())):
        spare = max(sizes, key=lambda s: (sizes[s] - out[s], s))
        if sizes[spare] == out[spare]:
            raise ValueError("too few rows for the strata")
        out[spare] += 1
    return out


def gold_sample(df: DataFrame, stratum: str, key: str, each: int, seed: str) -> DataFrame:
    """SMP11: rows of each stratum in hash order, up to its target. The strata are four, so their counts are collected."""
    quota = targets({r[0]: r[1] for r in df.groupBy(stratum).count().collect()}, each)
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(sampling.digest(seed, F.col(key)), key))
    limit = F.create_map(*[F.lit(x) for kv in quota.items() for x in kv])[F.col(stratum)] if quota else F.lit(0)
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= limit).drop("_rank")
