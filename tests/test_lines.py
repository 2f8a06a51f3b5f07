"""Strict line scans against a plain reading of the same files."""

import json

import pytest
from pyspark.sql import types as T

from trailmill.sources import lines

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("t", T.StringType())])


def plain(folder):
    out = []
    for f in sorted(folder.iterdir()):
        if f.suffix == ".jsonl":
            raw = f.read_bytes().split(b"\n")
            raw = [x + b"\n" for x in raw[:-1]] + ([raw[-1]] if raw[-1] else [])
            out += [(f.name, i, x) for i, x in enumerate(raw, 1)]
    return out


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    for k, n in enumerate((400, 1, 0, 37)):
        rows = [json.dumps({"id": i, "t": "é" * (i % 90) + " "}, ensure_ascii=False).encode() + (b"\r" if i % 7 == 0 else b"") + b"\n" for i in range(n)]
        (d / f"{k}.jsonl").write_bytes(b"".join(rows))
    return d


@pytest.mark.parametrize("split", ["1k", "333", "128m"])
def test_numbers_over_splits(spark, folder, split):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        (folder / "4.jsonl").write_bytes(b'{"id": 1}\n\n{"id": 2}')
        rows = lines.numbered(spark, str(folder))
        got = sorted((r["path"].rsplit("/", 1)[1], r["number"], bytes(r["raw"])) for r in rows.collect())
        assert got == plain(folder)
        assert rows.filter("NOT ended").count() == 1
        (folder / "4.jsonl").unlink()
        strict = lines.read_strict(spark, str(folder), SCHEMA).collect()
        assert len(strict) == 438 and all(r["record"]["id"] == r["number"] - 1 for r in strict)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("content, number, problem", [
    (b'{"id": 1}\n\n', 2, "blank"), (b'{"id": 1}\n \t\r\n', 2, "blank"), (b'{"id": 1}\n{"id": 2}', 2, "no_final_newline"), (b'{"id": 1} x\n', 1, "not_json"), (b'{"id": 1}\n{"id": 1}}\n[]\n', 2, "not_json"),
    (b'{"id": 1}\n[1]\n', 2, "not_object"), (b'"s"\n', 1, "not_object"), (b'{"id": "\xff"}\n', 1, "not_json"), (b" ", 1, "blank"),
])
def test_faults_name_their_line(spark, folder, content, number, problem):
    (folder / "9.jsonl").write_bytes(content)
    with pytest.raises(lines.LineFault) as e:
        lines.read_strict(spark, str(folder), SCHEMA)
    assert (e.value.path.rsplit("/", 1)[1], e.value.number, e.value.problem) == ("9.jsonl", number, problem)
    report = lines.examined(spark, str(folder), SCHEMA).filter("problem IS NOT NULL").orderBy("number").first()
    assert (report["number"], report["problem"], report["record"]) == (number, problem, None)


def test_lenient(spark, folder):
    assert lines.read_lenient(spark, str(folder / "none"), SCHEMA).count() == 0
    (folder / "9.jsonl").write_bytes(b'\n{"id": 5}\n  \nbad\n{"id": 6}')
    with pytest.raises(lines.LineFault, match="9.jsonl:4: not_json"):
        lines.read_lenient(spark, str(folder), SCHEMA)
    got = lines.read_lenient(spark, str(folder / "9.jsonl"), SCHEMA, skip=True).orderBy("number").collect()
    assert [(r["number"], r["record"]["id"]) for r in got] == [(2, 5), (5, 6)]


def test_unique(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b'{"id": 5}\n{"id": 6}\n')
    rows = lambda: lines.read_strict(spark, str(tmp_path / "a.jsonl"), SCHEMA)
    assert lines.unique_by(rows(), "id").count() == 2
    (tmp_path / "a.jsonl").write_bytes(b'{"id": 5}\n{"id": 6}\n{"id": 5}\n')
    with pytest.raises(lines.LineFault, match="a.jsonl:3: id was there before"):
        lines.unique_by(rows(), "id")
    (tmp_path / "a.jsonl").write_bytes(b'{"id": 5}\n{"t": "x"}\n')
    with pytest.raises(lines.LineFault, match="a.jsonl:2: no id"):
        lines.unique_by(rows(), "id")
