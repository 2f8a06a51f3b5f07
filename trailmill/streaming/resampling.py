"""STM6: groups of rollouts gathered batch by batch until there are enough for an update.

Every micro-batch brings generated groups. Those that teach something are kept; once target groups are
together an update takes the first of them and the gathering starts anew. After most batches without
enough, what was gathered goes and the update is skipped; after so many skips in a row the stream stops.

All that a micro-batch decides lies in folders named by its number: kept groups, the chosen rows and one row of
state. A batch reads the state of the one before it, so a batch that runs again, after a stop at any point,
writes the same once more and changes nothing else. The state's row is written last. The driver sees counts only; at most target
groups are ever ordered at once.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grpo import kept_groups
from ..sources.files import exists

# Batches that one update may gather from, skips in a row that stop the stream.
MOST_BATCHES, MOST_SKIPS = 3, 10
FIRST = {"batch": -1, "since": 0, "gathered": 0, "generated": 0, "all_equal": 0, "all_zero": 0, "updates": 0, "skips": 0, "skips_in_row": 0, "outcome": ""}


class NoSignal(RuntimeError):
    """Too many updates in a row were skipped."""


class Resampler:
    """foreachBatch handler over rollouts (group, utility, reward and what else they have)."""

    def __init__(self, folder: str, target: int, group: str, utility: str, reward: str, valid: Column, most_batches: int = MOST_BATCHES, most_skips: int = MOST_SKIPS):
        if min(target, most_batches, most_skips) < 1:
            raise ValueError("target, most_batches and most_skips must be positive")
        self.folder, self.target, self.most_batches, self.most_skips = folder, target, most_batches, most_skips
        self.group, self.utility, self.reward, self.valid = group, utility, reward, valid

    def state(self, spark: SparkSession, batch: int) -> dict:
        """The state after a batch; before the first one it is empty."""
        if batch < 0:
            return dict(FIRST)
        return json.loads(spark.read.text(f"{self.folder}/state/{batch}").first()[0])

    def __call__(self, rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        now = self.state(spark, batch - 1)
        if now["outcome"] == "stopped":
            raise NoSignal(f"{now['skips_in_row']} updates in a row were skipped")
        if now["outcome"]:  # the batch before ended an update
            now |= {"since": batch, "gathered": 0, "generated": 0, "all_equal": 0, "all_zero": 0}
        rows = rows.persist()
        try:
            groups = kept_groups(rows, self.group, self.utility, self.reward, self.valid)
            kept = groups.filter("kept").select(self.group)
            # a group is told by its name, so the order does not change when the batch runs again
            chosen = kept.orderBy(self.group).limit(self.target - now["gathered"])
            place = F.lit(now["updates"]).alias("update")
            rows.join(chosen, self.group, "left_semi").select(place, F.lit(batch).cast("long").alias("batch"), *[F.col(f"`{c}`") for c in rows.columns]).write.mode("overwrite").parquet(f"{self.folder}/chosen/{batch}")
            total = rows.select(self.group).distinct().count()
            n, equal, zero = groups.agg(F.sum(F.col("kept").cast("long")), F.sum(F.col("all_equal").cast("long")), F.sum(F.col("all_zero").cast("long"))).first()
        finally:
            rows.unpersist()
        now |= {"batch": batch, "gathered": now["gathered"] + (n or 0), "generated": now["generated"] + total, "all_equal": now["all_equal"] + (equal or 0), "all_zero": now["all_zero"] + (zero or 0)}
        if now["gathered"] >= self.target:
            now |= {"outcome": "update", "updates": now["updates"] + 1, "skips_in_row": 0}
        elif batch - now["since"] + 1 >= self.most_batches:
            skips = now["skips_in_row"] + 1
            now |= {"outcome": "stopped" if skips >= self.most_skips else "skip", "skips": now["skips"] + 1, "skips_in_row": skips}
        else:
            now |= {"outcome": ""}
        spark.createDataFrame([(json.dumps(now, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/state/{batch}")
        if now["outcome"] == "stopped":
            raise NoSignal(f"{now['skips_in_row']} updates in a row were skipped")


def history(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each batch: what it found the gathering at, and its outcome (update, skip, stopped or nothing yet)."""
    schema = "batch long, since long, gathered long, generated long, all_equal long, all_zero long, updates long, skips long, skips_in_row long, outcome string"
    if not exists(spark, f"{folder}/state"):
        return spark.createDataFrame([], schema)
    return spark.read.option("recursiveFileLookup", True).text(f"{folder}/state").select(F.from_json("value", schema).alias("s")).select("s.*")


def updates(spark: SparkSession, folder: str) -> DataFrame:
    """The rollouts of all updates that came about, with update and batch; what skipped gatherings chose is left out."""
    ended = history(spark, folder).filter("outcome = 'update'").select("since", F.col("batch").alias("until"), (F.col("updates") - 1).alias("nth"))
    rows = spark.read.option("recursiveFileLookup", True).parquet(f"{folder}/chosen")
    return rows.join(ended, (F.col("update") == F.col("nth")) & F.col("batch").between(F.col("since"), F.col("until"))).drop("since", "until", "nth")


def resample(rollouts: DataFrame, handler: Resampler, checkpoint: str):
    """Start the stream; it ends when its input does (availableNow) or with NoSignal."""
    return rollouts.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
