"""Plans over attempts and batches: splits, schedules, unions, digests, rankings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sampling import digest, fraction

#: Places of a fixed interleaving: two rounds of five labels. Fixed values.
PATTERN = ("easy", "medium", "medium", "hard", "medium")


def task_split(df: DataFrame, key: str, ratio: float, seed: str) -> DataFrame:
    """SMP4: all rows of a task on one side; round-half-even(n * ratio) tasks, one at least of each side, are validation.

    The tasks' order is by hash; the cut is a top-k of it, not a window over all tasks.
    """
    tasks = df.select(key).distinct()
    n = tasks.count()
    size = max(1, min(round(n * ratio), n - 1)) if ratio > 0 and n > 1 else 0
    chosen = tasks.orderBy(digest(seed, F.col(key)), key).limit(size).withColumn("_in", F.lit(True))
    return df.join(chosen, key, "left").withColumn("split", F.when(F.col("_in"), "validation").otherwise("train")).drop("_in")


def pattern_plan(counts: dict[str, int], pattern: Iterable[str] = PATTERN, times: int = 2) -> list[str]:
    """SMP10: labels in the order of a pattern that repeats; what a label lacks is skipped, what is left over follows by label."""
    left, out = dict(counts), []
    for label in [*pattern] * times:
        if left.get(label, 0) > 0:
            left[label] -= 1
            out.append(label)
    return out + [label for label in sorted(left) for _ in range(left[label])]


def next_attempts(tasks: DataFrame, log: DataFrame, key: str, valid: Column, gold: Column, most_valid: int, most_retries: int) -> DataFrame:
    """SMP13, AG19: tasks that need another attempt, with its number: fewer than most_valid valid ones, none gold, retries left."""
    done = log.groupBy(key).agg(F.count(F.when(valid, 1)).alias("_valid"), F.count(F.when(~valid, 1)).alias("_retries"), F.coalesce(F.max(gold & valid), F.lit(False)).alias("_gold"))
    state = tasks.join(done, key, "left").fillna({"_valid": 0, "_retries": 0}).withColumn("_gold", F.coalesce("_gold", F.lit(False)))
    open_ = state.filter((F.col("_valid") < most_valid) & ~F.col("_gold") & (F.col("_retries") <= most_retries))
    return open_.select(key, F.col("_valid").alias("attempt_index"), F.col("_retries").alias("retry_index"))


def completeness(expected: DataFrame, log: DataFrame, key: str, index: str, attempts: int) -> DataFrame:
    """AG19: for each expected key the attempts it has, and whether they are exactly 0 to attempts - 1, too few or too many."""
    have = log.groupBy(key).agg(F.array_sort(F.collect_list(index)).alias("_have"))
    n = F.coalesce(F.size("_have"), F.lit(0))
    n = F.greatest(n, F.lit(0))
    wanted = F.array(*[F.lit(i).cast(log.schema[index].dataType) for i in range(attempts)])
    state = F.when(F.col("_have") == wanted, "complete").when(n > attempts, "excessive").otherwise("incomplete")
    return expected.select(key).join(have, key, "left").select(key, n.cast("long").alias("n"), state.alias("state"))


def weighted_pick(df: DataFrame, key: str, weight: str, limit: int, seed: str) -> DataFrame:
    """SMP14: a weighted sample without replacement: the least -ln(u) / weight, u from the key's hash."""
    u = F.greatest(fraction(seed, F.col(key)), F.lit(1e-18))
    return df.filter(F.col(weight) > 0).withColumn("_at", -F.log(u) / F.col(weight)).orderBy("_at", key).limit(limit).drop("_at")


def perturbed(ranked: DataFrame, query: str, rank: str, mode: str, first: int = 20, seed: str = "perturb") -> DataFrame:
    """SRT7: ranks anew: `shuffle` puts the first ranks in hash order, `rotate` puts the next as many in front of them."""
    if mode == "shuffle":
        place = F.when(F.col(rank) <= first, F.struct(F.lit(0).alias("a"), digest(seed, F.concat_ws(":", query, rank)).alias("b"), F.col(rank).alias("c"))).otherwise(F.struct(F.lit(1).alias("a"), F.lit("").alias("b"), F.col(rank).alias("c")))
    elif mode == "rotate":
        place = F.struct(F.when(F.col(rank).between(first + 1, 2 * first), 0).when(F.col(rank) <= first, 1).otherwise(2).alias("a"), F.lit("").alias("b"), F.col(rank).alias("c"))
    else:
        raise ValueError("modes are shuffle and rotate")
    return ranked.withColumn("new_rank", F.row_number().over(Window.partitionBy(query).orderBy(place)))


def case_order(df: DataFrame, key: str, group: str, diversity: str, gap: str, seed: str) -> DataFrame:
    """SRT6: place in the group by diversity, then gap, both falling, then hash."""
    by = Window.partitionBy(group).orderBy(F.col(diversity).desc(), F.col(gap).desc(), digest(seed, F.col(key)), key)
    return df.withColumn("place", F.row_number().over(by))


def batches(frames: list[DataFrame], key: str) -> DataFrame:
    """SET1: all batches in order; a key in two rows is an error."""
    out = None
    for i, df in enumerate(frames):
        one = df.withColumn("batch_pos", F.lit(i))
        out = one if out is None else out.unionByName(one)
    n = F.count("*").over(Window.partitionBy(key))
    return out.withColumn("_n", n).withColumn("_bad", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("repeated key "), F.col(key).cast("string"))).cast("string"))).filter(F.col("_bad").isNull()).drop("_n", "_bad")


def overlaps(sets: dict[str, DataFrame], key: str) -> DataFrame:
    """SET6: keys that each two of the sets share: one pass over the sets' memberships, a bit for each set."""
    names = sorted(sets)
    rows = None
    for i, name in enumerate(names):
        one = sets[name].select(key, F.lit(1 << i).cast("long").alias("_bit"))
        rows = one if rows is None else rows.unionByName(one)
    masks = rows.groupBy(key).agg(F.bit_or("_bit").alias("_mask"))
    both = lambda i, j: F.count(F.when(F.col("_mask").bitwiseAND(F.lit((1 << i) | (1 << j))) == ((1 << i) | (1 << j)), 1))
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    got = masks.agg(*[both(i, j).alias(f"p{i}_{j}") for i, j in pairs])
    return got.select(F.explode(F.array(*[F.struct(F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"), F.col(f"p{i}_{j}").alias("n")) for i, j in pairs])).alias("r")).select("r.*")


def matched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """JN2: an inner N:1 join; a left row without its right row is an error."""
    marked = right.withColumn("_hit", F.lit(True))
    bad = F.when(F.col("_hit").isNull(), F.raise_error(F.concat(F.lit("no row for "), F.col(key).cast("string"))).cast("string"))
    return left.join(marked, key, "left").withColumn("_bad", bad).filter(F.col("_bad").isNull()).drop("_hit", "_bad")


def source_counts(df: DataFrame, source: str, key: str) -> DataFrame:
    """AG27: rows and distinct keys of each source."""
    return df.groupBy(source).agg(F.count("*").alias("rows"), F.count_distinct(key).alias("tasks"))


def best_and_last(log: DataFrame, run: str, step: str, loss: str) -> DataFrame:
    """AG30: the least loss with its first step, and the last loss, of each run."""
    finite = F.when(F.col(loss).isNotNull() & ~F.isnan(loss), F.col(loss))
    return log.withColumn("_l", finite).filter(F.col("_l").isNotNull()).groupBy(run).agg(F.min("_l").alias("best_loss"), F.min_by(F.col(step), F.struct("_l", step)).alias("best_step"), F.max_by("_l", F.col(step)).alias("last_loss"), F.count("*").alias("n"))


def manifest_digest(files: DataFrame) -> DataFrame:
    """AG31: one sha256 over the sorted `path:bytes:sha256` lines of a manifest (a row for each file)."""
    line = F.concat_ws(":", "path", "bytes", "sha256")
    return files.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("digest"), F.count("*").alias("files"))
