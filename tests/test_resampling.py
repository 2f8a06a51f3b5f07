"""Bounded resampling against a fold over the batches; a batch that runs again changes nothing."""

import random

import pytest
from pyspark.sql import functions as F

from trailmill.streaming import resampling as r

SCHEMA = "g string, u double, reward double, ok boolean, n long"


def batches(seed, n):
    rng = random.Random(seed)
    out = []
    for b in range(n):
        rows = []
        for g in range(6):
            same = rng.random() < 0.6
            rows += [(f"{b}-{g}", 0.5 if same else float(i), 0.5 if same else float(i), rng.random() < 0.9, b * 100 + g * 10 + i) for i in range(4)]
        out.append(rows)
    return out


def kept(rows):
    out = []
    for g in sorted({x[0] for x in rows}):
        v = [x for x in rows if x[0] == g and x[3]]
        if len(v) >= 2 and max(x[1] for x in v) - min(x[1] for x in v) > 1e-8:
            out.append(g)
    return out


def fold(found, target, most_batches, most_skips):
    """(outcome by batch, {update: groups})."""
    outcomes, chosen, gathered, since, row = [], {}, [], 0, 0
    for b, rows in enumerate(found):
        gathered += kept(rows)
        if len(gathered) >= target:
            chosen[len(chosen)] = gathered[:target]
            outcomes.append("update")
            gathered, since, row = [], b + 1, 0
        elif b - since + 1 >= most_batches:
            row += 1
            outcomes.append("stopped" if row >= most_skips else "skip")
            gathered, since = [], b + 1
            if row >= most_skips:
                break
        else:
            outcomes.append("")
    return outcomes, chosen


@pytest.mark.parametrize("target, most_batches, most_skips", [(5, 3, 10), (2, 1, 10), (30, 2, 2)])
def test_replay(spark, tmp_path, target, most_batches, most_skips):
    found = batches(target, 7)
    handler = r.Resampler(f"file://{tmp_path}/s", target, "g", "u", "reward", F.col("ok"), most_batches, most_skips)
    want, chosen = fold(found, target, most_batches, most_skips)
    for b, rows in enumerate(found[: len(want)]):
        df = spark.createDataFrame(rows, SCHEMA)
        for again in range(2 if b % 3 == 0 else 1):
            if want[b] == "stopped":
                with pytest.raises(r.NoSignal):
                    handler(df, b)
            else:
                handler(df, b)
    assert [x["outcome"] for x in r.history(spark, f"{tmp_path}/s").orderBy("batch").collect()] == want
    got = {}
    for x in r.updates(spark, f"{tmp_path}/s").collect():
        got.setdefault(x["update"], []).append((x["g"], x["n"]))
    assert {u: sorted({g for g, _ in x}) for u, x in got.items()} == {u: sorted(x) for u, x in chosen.items()}
    for u, x in got.items():
        assert sorted(n for _, n in x) == sorted(y[4] for rows in found for y in rows if y[0] in chosen[u])


def test_stream(spark, tmp_path):
    """Two runs on one checkpoint: batches follow on each other."""
    found = batches(3, 4)
    handler = r.Resampler(f"file://{tmp_path}/s", 4, "g", "u", "reward", F.col("ok"))
    for half in (found[:2], found[2:]):
        for rows in half:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        r.resample(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), handler, f"{tmp_path}/cp").awaitTermination()
    got = r.history(spark, f"{tmp_path}/s").orderBy("batch").collect()
    want, chosen = fold(found, 4, 3, 10)
    assert len(got) == 4 and sum(x["generated"] for x in got if x["outcome"]) > 0
    assert r.updates(spark, f"{tmp_path}/s").select("update").distinct().count() == sum(x["outcome"] == "update" for x in got)


def test_no_input(spark, tmp_path):
    assert r.history(spark, f"file://{tmp_path}/none").count() == 0
    with pytest.raises(ValueError):
        r.Resampler("x", 0, "g", "u", "reward", F.col("ok"))
