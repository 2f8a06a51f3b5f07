"""Sequence operators: one shuffle on the sequence key, then ordered windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(key: list[str], order: list) -> "Window":
    return Window.partitionBy(*key).orderBy(*order)


def first_per_key(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """WIN1, WIN2, JN4: the first row of each key in a total order."""
    return df.withColumn("_rn", F.row_number().over(ordered(key, order))).filter("_rn = 1").drop("_rn")


def latest_per_key(df: DataFrame, key: list[str], position: Column, ok: Column) -> DataFrame:
    """WIN7: the last successful row of each key of an append log; a plain aggregate with partial sums, no sort."""
    row = F.struct(*[c for c in df.columns if c not in key])
    return df.filter(ok).groupBy(*key).agg(F.max_by(row, position).alias("r")).select(*key, "r.*")


def duplicate_counts(df: DataFrame, key: list[str], signature: list[str], order: list) -> DataFrame:
    """WIN3: rows, repeats of an earlier signature, and repeats of the one just before."""
    seen = F.row_number().over(ordered(key + signature, order))
    sig = F.struct(*signature)
    return (
        df.withColumn("_seen", seen).withColumn("_same", sig == F.lag(sig).over(ordered(key, order)))
        .groupBy(*key)
        .agg(F.count("*").alias("n_steps"), F.sum((F.col("_seen") > 1).cast("long")).alias("n_duplicate"), F.sum(F.coalesce("_same", F.lit(False)).cast("long")).alias("n_consecutive"))
    )


def longest_run(df: DataFrame, key: list[str], signature: list[str], order: list) -> DataFrame:
    """WIN4: the longest run of one signature (gaps and islands)."""
    island = F.row_number().over(ordered(key, order)) - F.row_number().over(ordered(key + signature, order))
    runs = df.withColumn("_island", island).groupBy(*key, *signature, "_island").agg(F.count("*").alias("_n"))
    return runs.groupBy(*key).agg(F.max("_n").alias("longest_run"))


def since_progress(df: DataFrame, key: list[str], order: list, progress: Column) -> DataFrame:
    """WIN11: step number and steps since the last progress (since the start before any)."""
    w = ordered(key, order)
    out = df.withColumn("step", F.row_number().over(w))
    last = F.max(F.when(progress, F.col("step"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("no_progress_steps", F.col("step") - F.coalesce(last, F.lit(0)))


def streaks(df: DataFrame, key: list[str], order: list, hit: Column) -> DataFrame:
    """WIN13: length so far of the run of hits that ends at each row, 0 elsewhere."""
    w = ordered(key, order).rowsBetween(Window.unboundedPreceding, 0)
    block = df.withColumn("_hit", hit).withColumn("_block", F.sum((~F.col("_hit")).cast("long")).over(w))
    run = F.sum(F.col("_hit").cast("long")).over(ordered([*key, "_block"], order).rowsBetween(Window.unboundedPreceding, 0))
    return block.withColumn("streak", F.when(F.col("_hit"), run).otherwise(0)).drop("_hit", "_block")


def recent_repeat(df: DataFrame, key: list[str], order: list, signature: Column, back: int = 3) -> DataFrame:
    """WIN10: whether the signature is among the last `back` ones."""
    w = ordered(key, order)
    hits = [F.coalesce(signature == F.lag(signature, i).over(w), F.lit(False)) for i in range(1, back + 1)]
    any_hit = hits[0]
    for h in hits[1:]:
        any_hit = any_hit | h
    return df.withColumn("repeated", any_hit)


def as_of(df: DataFrame, key: list[str], order: list, value: Column, name: str) -> DataFrame:
    """JN9: the last non-null value strictly before each row."""
    w = ordered(key, order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def rolling_mean(df: DataFrame, key: list[str], order: list, value: str, n: int, name: str) -> DataFrame:
    """WIN5: mean of the last n non-null values, at rows that have a value."""
    w = ordered(key, order).rowsBetween(-(n - 1), 0)
    return df.filter(F.col(value).isNotNull()).withColumn(name, F.avg(value).over(w))


def suffix_within(df: DataFrame, key: list[str], order: str, size: Column, budget: int) -> DataFrame:
    """STM8: the longest suffix of whole rows within a budget; the last row always stays."""
    w = Window.partitionBy(*key).orderBy(F.col(order).desc())
    tail = df.withColumn("tail_size", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_back", F.row_number().over(w))
    return tail.filter((F.col("tail_size") <= budget) | (F.col("_back") == 1)).drop("_back")


def label_ranges(messages: DataFrame, key: str, order: str, role: str, n_tokens: str, trained: str = "assistant") -> DataFrame:
    """ARR9: start and end token offset of each message in its conversation, and whether its tokens keep labels."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.coalesce(F.col(n_tokens), F.lit(0))).over(w)
    return messages.withColumn("end", end).withColumn("start", F.col("end") - F.coalesce(F.col(n_tokens), F.lit(0))).withColumn("keeps", F.coalesce(F.col(role) == trained, F.lit(False)))


def mask_labels(ids, ranges):
    """ARR9: the ids inside any (start, end) of ranges, -100 elsewhere."""
    return F.transform(ids, lambda x, i: F.when(F.exists(ranges, lambda r: (i >= r["start"]) & (i < r["end"])), x).otherwise(F.lit(-100)))


def new_ids(shown: DataFrame, session: str, step: str, item: str) -> DataFrame:
    """WIN12: how many items each step of a session shows for the first time."""
    first = shown.filter(F.col(item).isNotNull()).groupBy(session, item).agg(F.min(step).alias(step))
    counts = first.groupBy(session, step).agg(F.count("*").alias("n_new"))
    return shown.select(session, step).distinct().join(counts, [session, step], "left").select(session, step, F.coalesce("n_new", F.lit(0)).alias("n_new"))
