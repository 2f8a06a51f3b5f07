"""The filter audit against its SQL and against filters applied one after the other."""

from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from trailmill.llm import filteraudit


def made():
    long = " ".join(f"w{i}" for i in range(120))
    texts = [
        long, long, long + " ", long + " #", "A" * 50, "A b", "a a a a a a", long.upper(), long.upper() + " |", "", None, " \n", "", "é" * 300, "é" * 299 + "e",
        "x" * 5000 + "y", "x" * 5000 + "y", "x" * 5000 + "z", "x" * 70_000 + "1", "x" * 70_000 + "2", "x" * 70_000 + "1", "x" * 300 + "q" * 100_000, "w " * 50_000,
        " ".join(f"w{i % 90}" for i in range(120)), " ".join(["dup"] * 100 + [f"w{i}" for i in range(400)]),
    ]
    rows = [(i, t, ["en", "fr", None, ""][i % 4], "c", 1) for i, t in enumerate(texts)]
    # a hot text, an id twice with one text, an id with two texts, null ids
    rows += [(100 + i, "hot text " * 30, "en", "c", 1) for i in range(12)]
    return [*rows, rows[15], rows[15], (16, long, "de", "c", 1), (17, "x" * 5000 + "y", "de", "c", 1), (None, long, "en", "c", 1), (None, "only here", "en", "c", 1), (40, "only here", "en", "c", 1)]


LABELS = [(0, 1, 0), (1, 1, 1), (1, 0, 0), (2, None, 1), (15, 1, 0), (105, 1, None), (None, 1, 1), (999, 1, 1), (40, 0, 1)]


def brute(rows):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    docs = []
    for i, t, lang, *_ in rows:
        t = t or ""
        w = t.encode().split()
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and first[t] < i}
        good, toxic = (any(x[0] is not None and x[0] == i and x[k] == 1 for x in LABELS) for k in (1, 2))
        docs.append((lang or "", {k for k, v in fails.items() if v}, good, toxic))
    out, shapley = [], {}
    for part in {d[0] for d in docs}:
        for order in permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            for step, name in enumerate(order, 1):
                gone = [d for d in left if name in d[1]]
                redundant = sum(d[0] == part and name in d[1] for d in docs) - len(gone)
                left = [d for d in left if name not in d[1]]
                out.append([part, "".join(order), step, len(left), len(gone), redundant, sum(d[0] == part and d[1] == {name} for d in docs), sum(d[2] for d in gone), sum(d[3] for d in gone)])
                shapley[part, name] = shapley.get((part, name), 0) + len(gone)
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("audit"))
    spark.createDataFrame(made(), "doc_id long, text string, lang string, `first` string, n long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_op13(spark, sf):
    got = __spark_entry__.queries()["op13_filteraudit"](spark, sf)
    want = brute(made())
    assert sorted(map(tuple, got.collect())) == want
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
    sql = con.sql(__spark_entry__.oracle_sql()["op13_filteraudit"])
    assert sql.columns == got.columns and sorted(sql.fetchall()) == want


@pytest.mark.parametrize("bits", [0, 1])
def test_texts_that_differ_under_equal_hashes(spark, sf, bits):
    """With hashes of no or one bit, texts of a class differ and are compared one by one."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    assert sorted(map(tuple, filteraudit.audit(filteraudit.masks(docs, labels, bits)).collect())) == brute(made())


def test_refinement_keeps_classes_of_several(spark, sf):
    left = filteraudit.refined(filteraudit.scanned(spark.read.parquet(f"{sf}/documents.parquet")))
    assert {r[0] for r in left.select("doc_id").collect()} == {0, 1, 16, 10, 9, 12, 15, 17, 18, 20, *range(100, 112)}
    assert left.groupBy(*filteraudit.KEYS).count().filter(F.col("count") < 2).count() == 0


def test_empty_table(spark, sf, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert __spark_entry__.queries()["op13_filteraudit"](spark, str(tmp_path)).collect() == []
