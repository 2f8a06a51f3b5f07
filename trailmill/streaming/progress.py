"""STM1: the progress tracker with result-set fingerprints and capped credit, as a keyed stream and as its batch twin.

A step names an action and what the page then shows. Evidence is what a session has not had before: a result
set (a search or turn of pages that shows an unseen list with enough unseen ids), an opened product, an
information page of a product, a chosen option, a met constraint. Any evidence is progress; only as much of
it as the caps allow earns credit. A session ends at the third equal action in a row, after four steps
without progress (both repeat_loop), or at the last step allowed (max_steps), tested in that order; later steps change nothing.

The stream keeps, for each session, one row of counters and a map from evidence to nothing. A session has
at most STEPS steps, so the map is bounded by what that many pages show; it is cleared when the session
ends, and where ttl_ms is given every entry expires so long after its last change. Steps of a micro-batch are put in order; a step at or before one that was
counted is a repeat or too late and is left out, as the twin does with repeated steps. The batch twin takes the first STEPS steps of a session, cut before they are moved; a
piece of evidence is counted at its first step, by partial sums, and only counters meet in windows.

Edge cases: a null name or argument counts as empty; a null list, map or page type has nothing; null ids are
left out; a null session is a session of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# The limits of a session, the unseen ids that a result set needs, and how much evidence earns credit.
REPEATS, STALLED, STEPS, NEW_IDS = 2, 4, 35, 3
CAPS = {"result_set": 3, "product": 5, "subpage": 6}
# Actions, turns of pages, the page type of a product's information.
SEARCH, CLICK, TURNS, SUBPAGE = "search", "click", ("next >", "< prev"), "information_subpage"
KINDS = ("result_set", "product", "subpage", "option", "constraint")
PRODUCT_ID = r"^[0-9]{8,12}$"

STEP = "session string, step long, name string, argument string, visible array<string>, page_type string, options map<string,string>, constraints array<string>"
OUT = "session string, steps int, ended string, repeats int, stalled int, seen_ids int, opened int, " + ", ".join(f"{k} int" for k in KINDS)
_COUNTS = ("steps", "repeats", "stalled", "seen_ids", *(f"n_{k}" for k in KINDS))
_STATE = "last string, ended string, step long, " + ", ".join(f"{c} int" for c in _COUNTS)


def _text(x: Any) -> str:
    return "" if x is None or x is pd.NA or (isinstance(x, float) and x != x) else str(x)


class Step(NamedTuple):
    """What one step says, normalised."""

    action: str
    argument: str
    visible: list[str]
    page_type: str
    options: dict[str, str]
    constraints: list[str]

    @classmethod
    def of(cls, r: Any) -> "Step":
        pairs = r.options if r.options is not None else {}
        pairs = dict(pairs) if not isinstance(pairs, dict) else pairs
        ids = [str(x) for x in (r.visible if r.visible is not None else []) if x is not None]
        said = [str(x) for x in (r.constraints if r.constraints is not None else []) if x is not None]
        return cls(_text(r.name).strip().lower(), _text(r.argument).strip().lower(), ids, _text(r.page_type), {k: _text(v) for k, v in pairs.items()}, said)

    @property
    def signature(self) -> str:
        return f"{self.action}\0{self.argument}"

    def evidence(self, new_ids: int, product_id) -> Iterator[tuple[str, str, bool]]:
        """(kind, key, whether it counts if the key is new)."""
        if self.visible and (self.action == SEARCH or (self.action == CLICK and self.argument in TURNS)):
            yield "result_set", hashlib.sha256("\0".join(self.visible).encode()).hexdigest(), new_ids >= NEW_IDS
        if self.action == CLICK and product_id(self.argument):
            yield "product", self.argument, True
        if self.action == CLICK and self.page_type == SUBPAGE and self.visible:
            yield "subpage", f"{self.visible[0]}:{self.argument}", True
        if self.visible:
            for axis, value in sorted(self.options.items()):
                yield "option", f"{self.visible[0]}:{axis}:{value}", True
        for c in self.constraints:
            yield "constraint", c, True


class Tracker(StatefulProcessor):
    """The stream's side: counters and evidence of a session."""

    def __init__(self, ttl_ms: int | None, product_id: str):
        self.ttl_ms, self.pattern = ttl_ms, product_id

    def init(self, handle: StatefulProcessorHandle) -> None:
        import re

        self.product_id = re.compile(self.pattern).search
        self.now = handle.getValueState("now", _STATE, self.ttl_ms)
        self.had = handle.getMapState("had", "kind string, key string", "at int", self.ttl_ms)

    def _new(self, kind: str, key: str) -> bool:
        if self.had.containsKey((kind, key)):
            return False
        self.had.updateValue((kind, key), (0,))
        return True

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        names = ["last", "ended", "step", *_COUNTS]
        now = dict(zip(names, self.now.get())) if self.now.exists() else {"last": "", "ended": "", "step": None} | dict.fromkeys(_COUNTS, 0)
        began = now["steps"]
        for r in pd.concat(list(rows)).sort_values("step").itertuples():
            if now["ended"] or (now["step"] is not None and r.step <= now["step"]):
                continue
            s = Step.of(r)
            now["repeats"] = now["repeats"] + 1 if now["steps"] and s.signature == now["last"] else 0
            now["last"], now["step"], now["steps"] = s.signature, int(r.step), now["steps"] + 1
            new_ids = sum(self._new("id", x) for x in set(s.visible))
            now["seen_ids"] += new_ids
            progress = False
            for kind, what, counts in s.evidence(new_ids, self.product_id):
                if self._new(kind, what) and counts:
                    now[f"n_{kind}"] += 1
                    progress = True
            now["stalled"] = 0 if progress else now["stalled"] + 1
            now["ended"] = "repeat_loop" if now["repeats"] >= REPEATS or now["stalled"] >= STALLED else "max_steps" if now["steps"] >= STEPS else ""
        if now["ended"]:
            self.had.clear()
        self.now.update(tuple(now[c] for c in names))
        if now["steps"] > began:
            row = {"session": [key[0]], **{c: [now[c]] for c in ("steps", "ended", "repeats", "stalled", "seen_ids")}, "opened": [now["n_product"]]}
            yield pd.DataFrame(row | {k: [min(now[f"n_{k}"], CAPS.get(k, STEPS * 1000))] for k in KINDS})

    def close(self) -> None:
        pass


def track(steps: DataFrame, ttl_ms: int | None = None, product_id: str = PRODUCT_ID) -> DataFrame:
    """How each session of a stream of STEP rows stands after each micro-batch that moved it (update mode).

    The session needs the RocksDB state store. With ttl_ms what a session has expires so long after its last
    change; Spark then runs the query by processing time, for which it needs a trigger that goes on.
    """
    return steps.groupBy("session").transformWithStateInPandas(Tracker(ttl_ms, product_id), OUT, "update", "none" if ttl_ms is None else "processingTime")


def track_batch(steps: DataFrame, product_id: str = PRODUCT_ID) -> DataFrame:
    """The batch twin of track(): how each session ends."""
    empty = F.array().cast("array<string>")
    clean = lambda c: F.filter(F.coalesce(F.col(c), empty), lambda x: x.isNotNull())
    low = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    # no session lives longer, so a long one sends STEPS rows from each task at most
    nth = F.row_number().over(Window.partitionBy("session").orderBy("step"))
    s = steps.dropDuplicates(["session", "step"]).withColumn("nth", nth).filter(F.col("nth") <= STEPS).select(
        F.coalesce(F.concat(F.lit("s"), F.col("session")), F.lit("")).alias("s"), "session", "step", low("name").alias("action"), low("argument").alias("argument"),
        clean("visible").alias("visible"), F.col("page_type"), F.map_entries(F.coalesce(F.col("options"), F.create_map().cast("map<string,string>"))).alias("options"), clean("constraints").alias("constraints"),
    )
    head = F.try_element_at("visible", F.lit(1))
    some, click = F.size("visible") > 0, F.col("action") == CLICK
    found: Column = F.col("argument").rlike(product_id)
    one = lambda kind, key, when: F.when(when, F.array(F.struct(F.lit(kind).alias("kind"), key.alias("key")))).otherwise(F.array().cast("array<struct<kind:string,key:string>>"))
    many = lambda kind, keys: F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))
    chosen = F.when(some, F.transform("options", lambda o: F.concat_ws(":", head, o["key"], F.coalesce(o["value"], F.lit(""))))).otherwise(empty)
    shown = F.concat(
        many("id", F.array_distinct("visible")),
        one("result_set", F.sha2(F.concat_ws("\0", "visible"), 256), some & ((F.col("action") == SEARCH) | (click & F.col("argument").isin(*TURNS)))),
        one("product", F.col("argument"), click & found),
        one("subpage", F.concat_ws(":", head, F.col("argument")), click & some & (F.col("page_type") == SUBPAGE)),
        many("option", chosen),
        many("constraint", F.col("constraints")),
    )
    first = s.select("s", "step", F.explode(shown).alias("x")).groupBy("s", "x.kind", "x.key").agg(F.min("step").alias("step"))
    fresh = first.groupBy("s", "step").agg(*[F.sum((F.col("kind") == k).cast("int")).alias(f"new_{k}") for k in ("id", *KINDS)])
    by = Window.partitionBy("s").orderBy("step")
    so_far = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = s.select("s", "session", "step", F.concat_ws("\0", "action", "argument").alias("signature")).join(fresh, ["s", "step"], "left").na.fill(0)
    rows = rows.withColumn("new_result_set", F.when(F.col("new_id") >= NEW_IDS, F.col("new_result_set")).otherwise(0))
    rows = rows.withColumn("n", F.row_number().over(by)).withColumn("changed", ~F.lag("signature").over(by).eqNullSafe(F.col("signature")))
    progress = sum((F.col(f"new_{k}") for k in KINDS), F.lit(0)) > 0
    rows = rows.withColumn("repeats", F.col("n") - F.max(F.when(F.col("changed"), F.col("n"))).over(so_far)).withColumn("stalled", F.col("n") - F.coalesce(F.max(F.when(progress, F.col("n"))).over(so_far), F.lit(0)))
    why = F.when((F.col("repeats") >= REPEATS) | (F.col("stalled") >= STALLED), "repeat_loop").when(F.col("n") >= STEPS, "max_steps")
    rows = rows.withColumn("why", why).withColumn("over", F.count("why").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    lived = rows.filter("over = 0")  # up to the step that ends the session
    last = lambda c: F.max_by(c, "n").cast("int")
    total = lambda k: F.sum(f"new_{k}").cast("int")
    out = lived.groupBy("s", "session").agg(
        F.max("n").alias("steps"), F.coalesce(F.max("why"), F.lit("")).alias("ended"), last("repeats").alias("repeats"), last("stalled").alias("stalled"), total("id").alias("seen_ids"), total("product").alias("opened"),
        *[(F.least(total(k), F.lit(CAPS[k])) if k in CAPS else total(k)).alias(k) for k in KINDS],
    )
    return out.drop("s")
