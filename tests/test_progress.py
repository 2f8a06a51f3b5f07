"""The full tracker: stream, batch twin and a plain fold agree."""

import random

import pytest

from trailmill.streaming import progress


def fold(steps):
    """A plain tracker over one session's steps in order."""
    seen, had, out = set(), {k: set() for k in progress.KINDS}, dict.fromkeys(progress.KINDS, 0)
    last, repeats, stalled, n, ended = None, 0, 0, 0, ""
    for _, _, name, argument, visible, page, options, constraints in steps:
        n += 1
        sig = ((name or "").strip().lower(), (argument or "").strip().lower())
        repeats = repeats + 1 if sig == last else 0
        last = sig
        visible = [x for x in visible or [] if x is not None]
        new = set(visible) - seen
        seen |= set(visible)
        moved = False

        def add(kind, key, counts=True):
            nonlocal moved
            if key not in had[kind]:
                had[kind].add(key)
                if counts:
                    out[kind] += 1
                    moved = True

        if visible and (sig[0] == "search" or sig[0] == "click" and sig[1] in ("next >", "< prev")):
            add("result_set", tuple(visible), len(new) >= 3)
        if sig[0] == "click" and sig[1].isdigit() and 8 <= len(sig[1]) <= 12:
            add("product", sig[1])
        if sig[0] == "click" and page == "information_subpage" and visible:
            add("subpage", (visible[0], sig[1]))
        for k, v in (options or {}).items() if visible else ():
            add("option", (visible[0], k, v or ""))
        for c in constraints or []:
            if c is not None:
                add("constraint", c)
        stalled = 0 if moved else stalled + 1
        ended = "repeat_loop" if repeats >= 2 or stalled >= 4 else "max_steps" if n >= 35 else ""
        if ended:
            break
    caps = {"result_set": 3, "product": 5, "subpage": 6}
    return (n, ended, repeats, stalled, len(seen), out["product"], *[min(out[k], caps.get(k, 10**9)) for k in progress.KINDS])


def made(seed=4):
    rng = random.Random(seed)
    rows = []
    for s in [*(f"s{i}" for i in range(25)), None]:
        lively = rng.random() < 0.5
        for step in range(rng.randrange(1, 60)):
            ids = [f"{10_000_000 + rng.randrange(40 if not lively else 4000)}" for _ in range(rng.randrange(6))]
            name = rng.choice(["search", "Click ", "click", "think", None])
            argument = rng.choice([*ids, "next >", "description", "red shoe", None] if lively else ["next >", "buy"])
            rows.append((s, step, name, argument, rng.choice([ids, ids, None, [None, *ids]]), rng.choice(["information_subpage", "item", None]), rng.choice([None, {}, {"colour": rng.choice(["red", "blue"]), "size": None}]), rng.choice([None, [], ["cheap"], [None, f"c{step}"]]) if lively else None))
    return rows


def key(r):
    return str(tuple(r))


def test_batch_is_the_fold(spark):
    rows = made()
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    got = progress.track_batch(spark.createDataFrame(rows + rows[5:20], progress.STEP).repartition(5)).collect()
    assert got[0].__fields__ == [c.split(" ")[0] for c in progress.OUT.split(", ")]
    assert sorted(map(key, got)) == sorted(key((s, *fold(x))) for s, x in by.items())
    assert {r["ended"] for r in got} == {"repeat_loop", "max_steps", ""}


def test_limits(spark):
    run = lambda steps: tuple(progress.track_batch(spark.createDataFrame([("s", i, *s) for i, s in enumerate(steps)], progress.STEP)).first())[1:]
    page = lambda *ids: ("search", "x" + "".join(ids), list(ids), None, None, None)
    # two new ids are no result set; a third equal action ends; caps hold for credit
    assert run([page("a", "b"), page("a", "b", "c")])[3:] == (2, 3, 0, 0, 0, 0, 0, 0)
    assert run([page("a", "b", "c")] * 5) == (3, "repeat_loop", 2, 2, 3, 0, 1, 0, 0, 0, 0)
    opens = [("click", str(10_000_000 + i), ["p"], None, None, None) for i in range(9)]
    assert run(opens) == (9, "", 0, 0, 1, 9, 0, 5, 0, 0, 0)
    assert run([("click", str(i), None, None, None, None) for i in range(9)])[:2] == (4, "repeat_loop")
    assert run([("click", str(i), ["p"], "information_subpage", None, None) for i in range(40)]) == (35, "max_steps", 0, 0, 1, 0, 0, 0, 6, 0, 0)


@pytest.mark.parametrize("parts", [4])
def test_stream_is_the_batch(spark, tmp_path, parts):
    """Over several micro-batches and a restart from its checkpoint, with steps that come again."""
    rows = made(9)
    folder = str(tmp_path / "in")

    def run():
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        stream = spark.readStream.schema(progress.STEP).option("maxFilesPerTrigger", 1).parquet(folder)
        progress.track(stream).writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(
            lambda df, i: df.withColumn("batch", df.session.isNull().cast("int") * 0 + int(i)).write.mode("append").parquet(str(tmp_path / "out"))
        ).start().awaitTermination()

    for p in range(parts):
        spark.createDataFrame([r for r in rows if r[1] * parts // 60 == p] + [r for r in rows if r[1] == 0][:4], progress.STEP).coalesce(1).write.mode("append").parquet(folder)
        if p % 2:
            run()
    got = {}
    for r in sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=lambda r: r["batch"]):
        got[r["session"]] = tuple(r)[:-1]
    assert sorted(map(key, got.values())) == sorted(map(key, progress.track_batch(spark.createDataFrame(rows, progress.STEP)).collect()))
