"""Compaction against a plain first fit and a brute-force reading of the files it leaves."""

import hashlib
import math
import os
import zlib
from datetime import datetime, timedelta

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__
from trailmill.llm import compaction

DAY = datetime(1970, 1, 1)


def first_fit(sizes, capacity):
    room, out = [], []
    for s in sizes:
        g = next((i for i, r in enumerate(room) if r >= s), None)
        if g is None:
            g = len(room)
            room.append(capacity)
        room[g] -= s
        out.append(g)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.integers(1, 60), st.booleans())
def test_first_fit(sizes, capacity, falling):
    sizes = sorted(sizes, reverse=True) if falling else sizes
    fit = compaction.FirstFit(sizes, capacity)
    assert [fit.place(s) for s in sizes] == first_fit(sizes, capacity)


def made(n):
    rows = []
    for i in range(n):
        day = 0 if i % 3 == 0 else i * 7 % 11  # a third of the rows has one day
        at = datetime(2024, 1, 1) + timedelta(days=day, seconds=i * 97 % 86_400)
        rows.append((i % (n - 40), at, at, i % 50, None if i % 9 == 0 else "view", None if i % 7 == 0 else i * 1.37 - 90, '{"k": %d}' % i, "extra"))
    rows += [rows[5], rows[5], (n, None, None, 1, "view", float("nan"), None, "x"), (n + 1, None, None, 1, None, float("inf"), "", "y"), (None, rows[3][1], rows[3][2], 1, None, 0.005, "", None)]
    before = datetime(1969, 12, 30, 23, 0)
    return [*rows, (n + 2, before, before, 1, "view", -0.5, "{}", "z")]


SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, `lot` string"


def expected(rows):
    """Per final file: day, lot, piece, rows in order, sources, rewritten."""
    share = lambda x: 1 + len(rows) // x
    day = lambda r: None if r[2] is None else (r[2] - DAY).days
    per_day = {}
    for r in rows:
        per_day[day(r)] = per_day.get(day(r), 0) + 1
    files = {}
    for r in rows:
        h = zlib.crc32(("" if r[0] is None else str(r[0])).encode())
        key = (day(r), h // 16 % (1 + per_day[day(r)] // share(150)), min(h % 4, h // 4 % 4))
        files.setdefault(key, []).append(r)
    for f in files.values():
        f.sort(key=lambda r: (r[2] is not None, r[2] or DAY, r[0] is not None, r[0] or 0))
    out = []
    for d in per_day:
        small = sorted((k for k in files if k[0] == d and len(files[k]) < share(600)), key=lambda k: (-len(files[k]), k[1], k[2]))
        groups = {}
        for k, g in zip(small, first_fit([len(files[k]) for k in small], share(500))):
            groups.setdefault(g, []).append(k)
        out += [[k] for k in files if k[0] == d and k not in small] + list(groups.values())
    return {g[0]: ([r for k in g for r in files[k]], ",".join(f"{k[1]}-{k[2]}" for k in g), len(g) > 1) for g in out}


@pytest.mark.parametrize("n", [30 + 40, 4000])
def test_op11(spark, tmp_path, n):
    rows = made(n)
    d = str(tmp_path / "sf")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{d}/clicks.parquet")
    got = __spark_entry__.queries()["op11_compaction"](spark, d).collect()
    want = expected(rows)
    assert {(r["day"], r["lot"], r["piece"]) for r in got} == set(want) and len(got) == len(want)
    cents = lambda v: math.floor(100 * v + 0.5) if v is not None and math.isfinite(v) else 0
    if n > 1000:
        assert any(r["rewritten"] for r in got) and not all(r["rewritten"] for r in got)
    for r in got:
        held, sources, rewritten = want[r["day"], r["lot"], r["piece"]]
        ids = [x[0] for x in held]
        known = [i for i in ids if i is not None]
        assert (r["n_rows"], r["min_click_id"], r["max_click_id"]) == (len(held), min(known, default=None), max(known, default=None))
        assert (r["cents"], r["sources"], r["rewritten"]) == (sum(cents(x[5]) for x in held), sources, rewritten)
        text = ",".join("" if i is None else str(i) for i in ids)
        assert r["ids_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        table = pq.ParquetFile(r["path"].removeprefix("file://")).read()
        assert ",".join(table.column_names) == r["columns"] == "click_id,ts,arrived_at,client_id,kind,value,props,lot"
        back = [tuple(x.values()) for x in table.to_pylist()]
        assert sorted(map(str, back)) == sorted(map(str, held)) and [x[0] for x in back] == ids
    folder = os.path.dirname(got[0]["path"].removeprefix("file://"))
    assert {f for f in os.listdir(folder) if f.endswith(".parquet")} == {os.path.basename(r["path"]) for r in got}
    assert not os.path.exists(folder + "-merged")


def test_untouched_files_keep_their_bytes(spark, tmp_path, monkeypatch):
    d = str(tmp_path / "sf")
    spark.createDataFrame(made(3000), SCHEMA).write.parquet(f"{d}/clicks.parquet")
    before = {}
    real = compaction.start

    def spy(table, folder, lots):
        real(table, folder, lots)
        at = folder.removeprefix("file://")
        before.update({f: open(f"{at}/{f}", "rb").read() for f in os.listdir(at) if f.endswith(".parquet")})

    monkeypatch.setattr(compaction, "start", spy)
    kept = [r["path"].removeprefix("file://") for r in __spark_entry__.queries()["op11_compaction"](spark, d).collect() if not r["rewritten"]]
    assert kept and all(open(p, "rb").read() == before[os.path.basename(p)] for p in kept)


def test_finish_may_run_again(spark, tmp_path):
    """Stopped after the merge or half way through the moves, a second run ends with the same files; without the merge it deletes nothing."""
    folder = "file://" + str(tmp_path / "t")
    spark.range(0, 12, 1, 4).write.parquet(folder)
    names = sorted(f for f in os.listdir(tmp_path / "t") if f.endswith(".parquet"))
    plan = spark.createDataFrame([(f, names[0], i, 3, 3) for i, f in enumerate(names[:3])], "name string, leader string, place int, members int, n_rows long")
    with pytest.raises(RuntimeError):
        compaction.finish(spark, folder, folder + "-merged", plan)
    schema = spark.read.parquet(folder).schema
    beside = compaction.merge(spark, schema, folder, plan)
    made_ = next(f for f in os.listdir(tmp_path / "t-merged") if f.endswith(".parquet"))
    os.rename(tmp_path / "t-merged" / made_, tmp_path / "t" / f"merged-{made_}")
    for _ in range(2):
        compaction.finish(spark, folder, beside, plan)
        assert sorted(r[0] for r in spark.read.parquet(folder).collect()) == list(range(12))
        assert len([f for f in os.listdir(tmp_path / "t") if f.endswith(".parquet")]) == 2


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/clicks.parquet")
    assert __spark_entry__.queries()["op11_compaction"](spark, str(tmp_path)).collect() == []
