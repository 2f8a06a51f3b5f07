"""Episode streams: keyed progress state, counters and event-time windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Repeats that make a loop, steps without progress, steps of an episode.
REPEATS, STALLED, STEPS = 2, 4, 35

STATE = "last string, repeats int, stalled int, steps int, seen array<string>, ended string"
OUT = "session string, steps int, ended string"


def advance(state: tuple, signature: str, evidence: list[str]) -> tuple:
    """One step of the tracker: (last, repeats, stalled, steps, seen, ended) -> the same.

    Exact repeats are tested first, then steps without new evidence, then the limit.
    """
    last, repeats, stalled, steps, seen, ended = state
    if ended:
        return state
    fresh = [e for e in evidence if e not in seen]
    repeats = repeats + 1 if signature == last else 0
    stalled = 0 if fresh else stalled + 1
    steps += 1
    ended = "repeat_loop" if repeats >= REPEATS else "no_progress" if stalled >= STALLED else "max_steps" if steps >= STEPS else ""
    return signature, repeats, stalled, steps, [*seen, *fresh], ended


def _track(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now = state.get if state.exists else ("", 0, 0, 0, [], "")
    rows = pd.concat(list(frames)).sort_values("step")
    for r in rows.itertuples():
        now = advance((*now[:4], list(now[4]), now[5]), r.signature, [r.evidence] if r.evidence else [])
    state.update(now)
    yield pd.DataFrame({"session": [key[0]], "steps": [now[3]], "ended": [now[5]]})


def track(steps: DataFrame) -> DataFrame:
    """STM1, STM3: how each session of a stream of (session, step, signature, evidence) stands."""
    return steps.groupBy("session").applyInPandasWithState(_track, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def track_batch(steps: DataFrame) -> DataFrame:
    """The batch twin of track(), by windows: the first step at which a rule holds ends a session."""
    by = Window.partitionBy("session").orderBy("step")
    so_far = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = steps.withColumn("n", F.row_number().over(by)).withColumn("changed", ~F.lag("signature").over(by).eqNullSafe(F.col("signature")))
    first = F.row_number().over(Window.partitionBy("session", "evidence").orderBy("step")) == 1
    rows = rows.withColumn("fresh", F.coalesce(F.col("evidence") != "", F.lit(False)) & first)
    rows = rows.withColumn("repeats", F.col("n") - F.max(F.when(F.col("changed"), F.col("n"))).over(so_far))
    rows = rows.withColumn("stalled", F.col("n") - F.coalesce(F.max(F.when(F.col("fresh"), F.col("n"))).over(so_far), F.lit(0)))
    why = F.when(F.col("repeats") >= REPEATS, "repeat_loop").when(F.col("stalled") >= STALLED, "no_progress").when(F.col("n") >= STEPS, "max_steps")
    ends = rows.withColumn("why", why)
    hit = F.when(F.col("why").isNotNull(), F.col("n"))
    out = ends.groupBy("session").agg(F.coalesce(F.min(hit), F.max("n")).cast("int").alias("steps"), F.coalesce(F.min_by("why", hit), F.lit("")).alias("ended"))
    return out.select("session", "steps", "ended")


def counters(events: DataFrame, key: str, value: str) -> DataFrame:
    """STM5: rows, sum and maximum by key; streaming in update mode or batch."""
    return events.groupBy(key).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("peak"))


def tumbling(events: DataFrame, ts: str, width: str, late: str | None = None) -> DataFrame:
    """Counts by event type and window; with a watermark on streams."""
    e = events.withWatermark(ts, late) if late else events
    return e.groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str | None = None) -> DataFrame:
    """Sessions of a key, ended by a gap."""
    e = events.withWatermark(ts, late) if late else events
    return e.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def once(events: DataFrame, ts: str, key: str, late: str) -> DataFrame:
    """STM7: each key once inside the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
