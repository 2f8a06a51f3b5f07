"""Trajectories with nested messages and steps as event rows, and what is counted over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import dealt

#: Fields of a message that training rows keep. Fixed values.
MESSAGE_FIELDS = ("role", "content", "tool_calls", "tool_call_id", "name")


def event_stream(trajectories: DataFrame, key: str) -> DataFrame:
    """PRJ7, JN8, WIN9: one row for each step and each blocked call, a call blocked at a step before that step.

    trajectories: key, steps array<struct<call_id, tool, action, error, reward, done>>, blocked array<struct<step_index,
    call_id, tool, reason>>, replies map<call_id, assistant text>. A blocked call without a place among the steps comes last.
    """
    n = F.size("steps")
    step = trajectories.select(key, "replies", F.posexplode("steps").alias("position", "s")).select(
        key, "replies", "position", F.lit(1).alias("rank"), F.lit(0).alias("nth"), F.lit("tool_step").alias("event_type"), F.col("s.call_id").alias("call_id"), F.col("s.tool").alias("tool"),
        F.col("s.action").alias("action"), F.col("s.error").alias("error"), F.lit(None).cast("string").alias("guard_reason"), F.col("s.reward").alias("reward"), F.col("s.done").alias("done"),
    )
    place = F.when(F.col("b.step_index").between(0, n), F.col("b.step_index")).otherwise(n + 1)
    guard = trajectories.select(key, "replies", "steps", F.posexplode("blocked").alias("nth", "b")).select(
        key, "replies", place.cast("int").alias("position"), F.lit(0).alias("rank"), "nth", F.lit("guard_rejection").alias("event_type"), F.col("b.call_id").alias("call_id"), F.col("b.tool").alias("tool"),
        F.lit(None).cast("string").alias("action"), F.lit(None).cast("string").alias("error"), F.coalesce("b.reason", F.lit("unknown")).alias("guard_reason"), F.lit(0.0).alias("reward"), F.lit(False).alias("done"),
    )
    number = F.row_number().over(Window.partitionBy(key).orderBy("position", "rank", "nth"))
    rows = dealt(step.unionByName(guard), key).withColumn("event_number", number).withColumn("assistant_text", F.coalesce(F.col("replies")[F.col("call_id")], F.lit("")))
    ids = rows.withColumn("event_id", F.format_string("e%04d", "event_number")).withColumn("action_attempt_id", F.format_string("a%04d", "event_number"))
    return ids.withColumn("source_step_index", F.when(F.col("rank") == 1, F.col("position"))).drop("replies", "rank", "nth", "position")


def signature(tool: Column, action: Column) -> Column:
    """AG12: what makes two calls the same: the folded action, or else the tool."""
    folded = F.lower(F.regexp_replace(F.trim(action), r"\s+", " "))
    return F.when(F.coalesce(folded, F.lit("")) != "", F.concat(F.lit("env:"), folded)).otherwise(F.concat(F.lit("tool:"), F.coalesce(F.lower(tool), F.lit(""))))


def behaviour(events: DataFrame, key: str, order: str = "event_number") -> DataFrame:
    """AG12, AG13, AG33, WIN3, WIN4, WIN15: a row of counts for each trajectory, by one pass of windows and one aggregate.

    events: key, order, event_type, tool, action, error, event_id.
    """
    by = Window.partitionBy(key).orderBy(order)
    step = F.col("event_type") == "tool_step"
    rows = events.withColumn("_sig", F.when(step, signature(F.col("tool"), F.col("action"))))
    # consecutive means next to each other among the steps
    rows = rows.withColumn("_before", F.last("_sig", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_same", F.coalesce(F.col("_sig") == F.col("_before"), F.lit(False)))
    rows = rows.withColumn("_run", F.sum(F.when(step & ~F.col("_same"), 1).otherwise(0)).over(by))
    rows = rows.withColumn("_length", F.when(step, F.count(F.when(step, 1)).over(Window.partitionBy(key, "_run"))))
    n = lambda c: F.count(F.when(c, 1))
    tool = lambda name: step & (F.col("tool") == name)
    out = rows.groupBy(key).agg(
        F.count("*").alias("n_events"), n(step).alias("n_steps"), n(~step).alias("n_guard_rejections"), n(step & F.col("error").isNotNull()).alias("n_errors"),
        n(tool("search")).alias("n_searches"), F.count_distinct(F.when(tool("search"), F.col("_sig"))).alias("n_distinct_searches"), n(tool("click")).alias("n_clicks"),
        F.count_distinct("_sig").alias("n_distinct_calls"), n(F.col("_same")).alias("n_consecutive_repeats"), F.coalesce(F.max("_length"), F.lit(0)).alias("longest_run"),
        F.min_by("event_id", F.when(tool("buy"), F.col(order))).alias("first_purchase_event"), F.max_by("event_id", F.col(order)).alias("last_event"),
    )
    return out.withColumn("n_exact_repeats", F.col("n_steps") - F.col("n_distinct_calls")).withColumn("error_rate", F.try_divide("n_errors", "n_steps"))


def kept_messages(messages: Column, blocked: Column) -> Column:
    """PRJ1, PRJ3: messages cut to the allowed fields, without the call pairs that the guard blocked.

    An assistant message goes when all its calls are blocked, a tool message when its call is; blocked is an array of call ids.
    """
    none = F.array().cast("array<string>")
    gone = F.coalesce(blocked, none)
    ids = lambda m: F.transform(F.coalesce(m["tool_calls"], F.array().cast("array<struct<id:string,name:string,arguments:string>>")), lambda c: c["id"])
    keep = lambda m: ~F.coalesce((m["role"] == "tool") & F.array_contains(gone, m["tool_call_id"]), F.lit(False)) & ~((F.size(ids(m)) > 0) & F.forall(ids(m), lambda i: F.array_contains(gone, i)))
    return F.transform(F.filter(messages, keep), lambda m: F.struct(*[m[c].alias(c) for c in MESSAGE_FIELDS]))


def training_row(trajectories: DataFrame, key: str, messages: Column, tools: Column, *metadata: dict[str, Column]) -> DataFrame:
    """PRJ2: messages, tools and metadata; of several dicts of metadata the later one's columns win."""
    merged: dict[str, Column] = {}
    for m in metadata:
        merged |= m
    return trajectories.select(key, messages.alias("messages"), tools.alias("tools"), F.struct(*[c.alias(n) for n, c in merged.items()]).alias("metadata"))


def panel(trajectories: DataFrame, key: str, *parts: DataFrame) -> DataFrame:
    """PRJ15, JN5: a row for every trajectory with a struct from each part, which must have it exactly once.

    A trajectory that a part lacks or repeats is an error, and so is a part's row without a trajectory.
    """
    out = trajectories
    for i, part in enumerate(parts):
        columns = [c for c in part.columns if c != key]
        one = part.groupBy(key).agg(F.count("*").alias("_n"), F.first(F.struct(*columns)).alias(f"panel_{i}"))
        both = out.withColumn("_left", F.lit(1)).join(one, key, "full_outer")
        bad = F.when(F.col("_left").isNull(), "unexpected").when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "repeated")
        out = both.withColumn("_bad", F.when(bad.isNotNull(), F.raise_error(F.concat_ws(" ", F.lit("panel"), F.lit(str(i)), bad, F.col(key).cast("string"))).cast("string"))).filter(F.col("_bad").isNull()).drop("_left", "_n", "_bad")
    return out
