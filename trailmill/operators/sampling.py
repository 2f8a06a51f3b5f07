"""Quotas, splits and plans in hash order: sha256 of "seed:id" ranks rows alike everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of a digest that name its range: 16 ** DIGITS ranges of a label.
DIGITS = 3


def digest(seed: str, key: Column) -> Column:
    """SRT3: the pseudo-random place of an id."""
    return F.sha2(F.concat_ws(":", F.lit(seed), key.cast("string")), 256)


def fraction(seed: str, key: Column) -> Column:
    """SMP5: an id's place in [0, 1) from the first 16 hex digits."""
    return F.conv(F.substring(digest(seed, key), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(16**16))


def largest_remainder(weights: DataFrame, label: str, weight: str, total: int) -> DataFrame:
    """SMP1: integer quotas of a total by weight; ties by label. A row for each label."""
    share = F.col(weight) * F.lit(float(total)) / F.sum(weight).over(Window.partitionBy())
    w = weights.withColumn("_share", share).withColumn("_floor", F.floor("_share"))
    missing = F.lit(total) - F.sum("_floor").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy((F.col("_share") - F.col("_floor")).desc(), label))
    return w.withColumn("_missing", missing).withColumn("_rank", rank).select(label, (F.col("_floor") + (F.col("_rank") <= F.col("_missing")).cast("long")).alias("quota"))


def hash_ranked(df: DataFrame, label: str, key: str, seed: str) -> DataFrame:
    """df with _rank, a row's place in its label in hash order, and _n, the label's rows.

    No task orders a label: rows are ranked inside 16 ** DIGITS ranges of the digest, and the ranges' row counts
    (a small table) give where each begins.
    """
    placed = df.withColumn("_place", digest(seed, F.col(key))).withColumn("_bucket", F.substring("_place", 1, DIGITS))
    sizes = placed.groupBy(label, "_bucket").agg(F.count("*").alias("_rows"))
    of_label = Window.partitionBy(label)
    before = of_label.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(label).alias("_l"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"), F.sum("_rows").over(of_label).alias("_n"))
    inside = F.row_number().over(Window.partitionBy(label, "_bucket").orderBy("_place", key))
    joined = placed.withColumn("_inside", inside).join(starts, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_bucket") == F.col("_b")))
    return joined.withColumn("_rank", F.col("_start") + F.col("_inside")).select(*df.columns, "_rank", "_n")


def take_quota(df: DataFrame, label: str, key: str, quota: DataFrame, seed: str) -> DataFrame:
    """SRT5: the first rows of each label in hash order, up to its quota."""
    return hash_ranked(df, label, key, seed).join(quota, label).filter(F.col("_rank") <= F.col("quota")).drop("_rank", "_n", "quota")


def balanced(df: DataFrame, label: str, key: str, quota: DataFrame, total: int, seed: str) -> DataFrame:
    """SMP2: quotas first, then leftovers of any label in hash order up to the total.

    Leftovers are cut by a top-k (TakeOrdered), not by a window over all rows.
    """
    ranked = hash_ranked(df, label, key, seed).join(quota, label, "left")
    chosen = ranked.filter(F.col("_rank") <= F.coalesce("quota", F.lit(0)))
    left = ranked.filter(F.col("_rank") > F.coalesce("quota", F.lit(0)))
    # what the quotas take follows from the labels' counts: a number, without ranking twice
    took = df.groupBy(label).agg(F.count("*").alias("_n")).join(quota, label).agg(F.sum(F.least("_n", "quota"))).first()[0]
    need = max(0, total - (took or 0))
    refill = left.orderBy(digest(seed, F.col(key)), key).limit(need)
    return chosen.select(*df.columns, F.lit("quota").alias("via")).unionByName(refill.select(*df.columns, F.lit("refill").alias("via")))


def stratified_split(df: DataFrame, label: str, key: str, ratio: float, seed: str) -> DataFrame:
    """SMP3: per label round-half-even(n * ratio) validation rows, clamped to [1, n - 1]."""
    quota = F.when((F.lit(ratio) > 0) & (F.col("_n") > 1), F.greatest(F.lit(1), F.least(F.bround(F.col("_n") * ratio, 0), F.col("_n") - 1))).otherwise(0)
    out = hash_ranked(df, label, key, seed)
    return out.withColumn("split", F.when(F.col("_rank") <= quota, "validation").otherwise("train")).drop("_n", "_rank")


def round_robin(df: DataFrame, group: list[str], key: str, limit: int, seed: str) -> DataFrame:
    """SMP7: one row of each group in turn, groups in order."""
    turn = F.row_number().over(Window.partitionBy(*group).orderBy(digest(seed, F.col(key)), key))
    return df.withColumn("turn", turn).orderBy("turn", *group).limit(limit)


def interleave(counts: dict[str, int]) -> list[str]:
    """SMP9: labels in the order of the largest deficit against their share; driver, from counts only."""
    total, used, out = sum(counts.values()), dict.fromkeys(counts, 0), []
    for i in range(1, total + 1):
        label = max(sorted(counts), key=lambda x: (counts[x] * i / total - used[x]) if used[x] < counts[x] else float("-inf"))
        used[label] += 1
        out.append(label)
    return out


def min_cost_flow(cells: dict[tuple[str, str], int], quotas: dict[str, int], per_category: int, cost: dict[tuple[str, str], float] | None = None) -> dict[tuple[str, str], int]:
    """SMP8, JN20: rows to take by (label, category): exact label quotas, at most per_category of a category, least cost.

    The input is an aggregated table, so the driver holds cells, not rows. Each unit goes along the cheapest
    augmenting path (Bellman-Ford over the residual network of labels and categories, ties by name). Quotas that
    the cells cannot meet are an error.
    """
    cost = cost or {}
    take = dict.fromkeys(sorted(cells), 0)
    load = dict.fromkeys(sorted({c for _, c in cells}), 0)
    for label in sorted(quotas):
        for _ in range(quotas[label]):
            # cheapest way from the label to every label and category: (cost, steps of (cell, +1 or -1))
            best: dict[tuple[str, str], tuple[float, tuple]] = {("label", label): (0.0, ())}
            changed = True
            while changed:
                changed = False
                for cell in take:
                    here, there = ("label", cell[0]), ("category", cell[1])
                    for a, b, sign, free in ((here, there, 1, take[cell] < cells[cell]), (there, here, -1, take[cell] > 0)):
                        if free and a in best:
                            price = best[a][0] + sign * cost.get(cell, 0.0)
                            if b not in best or price < best[b][0] - 1e-12:
                                best[b] = (price, (*best[a][1], (cell, sign)))
                                changed = True
            ends = [(best["category", c][0], c) for c in load if load[c] < per_category and ("category", c) in best]
            if not ends:
                raise ValueError(f"the quota of {label} cannot be met")
            _, end = min(ends)
            for cell, sign in best["category", end][1]:
                take[cell] += sign
            load[end] += 1
    return take
