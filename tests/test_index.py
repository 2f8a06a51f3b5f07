"""The stored index against a plain BM25 over all documents."""

import math
import os
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from trailmill.functions import text
from trailmill.operators import index
from trailmill.sources.shared import new_folder

FIELDS = {f: f for f in index.WEIGHTS}
SCHEMA = "id long, " + ", ".join(f"{f} string" for f in index.WEIGHTS)


def tokens(value):
    t = unicodedata.normalize("NFKC", value or "").casefold().replace("人民币", "元").replace("块钱", "元")
    t = re.sub(r"(?<=\d)\s*(?:rmb|cny|yuan)\b", "元", t)
    t = re.sub(r"[，,。；;：:！!？?、|]+", " ", t)
    out = []
    for run in re.findall("[㐀-䶿一-鿿]+", t):
        out += [run] if len(run) == 1 else [run[i : i + 2] for i in range(len(run) - 1)]
    return list(dict.fromkeys(out + re.findall(r"[a-z0-9]+(?:[._+\-/][a-z0-9]+)*", t)))


def brute(rows, queries, k, weights):
    docs = []
    for r in rows:
        tf, length = {}, 0
        for f, v in zip(index.WEIGHTS, r[1:]):
            found = tokens(v)
            parts = [p for x in found for p in re.split(r"[._+\-/]", x)]
            length += len(parts)
            for x in parts + [x for x in found if re.search(r"[._+\-/]", x)]:
                tf[x] = tf.get(x, 0) + weights[f]
        docs.append((r[0], tf, length))
    average = sum(d[2] for d in docs) / len(docs)
    out = []
    for q, t in queries:
        want = tokens(t)
        df = {x: sum(x in d[1] for d in docs) for x in want}
        scored = []
        for key, tf, length in docs:
            if any(x in tf for x in want):
                s = sum(max(1e-6, math.log((len(docs) - df[x] + 0.5) / (df[x] + 0.5))) * tf[x] * 2.2 / (tf[x] + 1.2 * (0.25 + 0.75 * length / average)) for x in want if x in tf)
                scored.append((-round(s, 9), key))
        out += [(q, key, i + 1, round(-s, 6)) for i, (s, key) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def rows(n=400, seed=1):
    rng = random.Random(seed)
    words = ["红色", "跑鞋", "轻便", "防水", "shoe", "light", "RTX-4090", "4090", "a/b", "x1", "１２元", "100 rmb", "鞋"]
    out = []
    for i in range(n):
        kind = rng.choice(["sport", "office", "home", "toys"])
        out.append((i, " ".join(rng.choices(words, k=4)), rng.choice(["Acme", "acme 中国", None]), kind, rng.choice(["x1", "", None]), f"{kind} {rng.choice(words)}", rng.choice(words), " ".join(rng.choices([*words, kind, f"w{i % 50}"], k=12))))
    return out


QUERIES = [(1, "红色跑鞋 sport"), (2, "rtx-4090, light!"), (3, "4090"), (4, "w7 w8 toys 100人民币"), (5, "   "), (6, None), (7, "nothing"), (8, "sport sport shoe"), (9, "鞋")]


@pytest.mark.parametrize("size, k", [(16, 5), (64, 20), (4096, 500)])
def test_search(spark, size, k):
    data = rows()
    folder = new_folder(spark, "index")
    docs = spark.createDataFrame(data, SCHEMA)
    digest = index.build(docs, "id", FIELDS, folder, ["category", "title"], size=size)
    found = index.opened(spark, folder, digest, thorough=True)
    got = index.search(found, spark.createDataFrame(QUERIES, "q long, t string"), "q", "t", k).collect()
    assert sorted((r["query"], r["key"], r["rank"], round(r["score"], 6)) for r in got) == brute(data, QUERIES, k, index.WEIGHTS)
    assert all(r["opened"] <= r["ranges"] for r in got)
    if size == 16:
        assert any(r["opened"] < r["ranges"] for r in got)
    assert found.contains(7) and not found.contains(-7)


def test_versions_and_faults(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    with pytest.raises(index.IndexFault):
        index.opened(spark, folder)
    one = index.build(spark.createDataFrame(rows(30), SCHEMA), "id", FIELDS, folder, ["category"])
    before = index.opened(spark, folder, one)
    two = index.build(spark.createDataFrame(rows(31, 2), SCHEMA), "id", FIELDS, folder, ["category"], {**index.WEIGHTS, "title": 9.0})
    now = index.opened(spark, folder, two)
    assert (before.manifest["documents"], now.manifest["documents"], now.manifest["weights"]["title"]) == (30, 31, 9.0)
    assert before.postings.count() > 0  # readers of the version before go on with it
    with pytest.raises(index.IndexFault, match="other rows"):
        index.opened(spark, folder, one)
    for bad in ({"title": 1.0}, {**index.WEIGHTS, "title": 0.0}, {**index.WEIGHTS, "brand": float("inf")}):
        with pytest.raises(ValueError):
            index.checked(bad)
    os.rename(tmp_path / "index" / now.manifest["tables"] / "terms", tmp_path / "gone")
    with pytest.raises(index.IndexFault, match="terms"):
        index.opened(spark, folder)
    spark.createDataFrame([('{"weights": 3}',)], "v string").write.text(f"{folder}/manifest-3")
    with pytest.raises(index.IndexFault, match="broken"):
        index.opened(spark, folder)


def test_first_of_each_key(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, " ", "z"), (4, None, "z"), (5, "nan", "z"), (6, "b", "z")], "n long, asin string, title string")
    assert sorted(tuple(r) for r in index.products(df, "asin", ["n"]).collect()) == [(1, "a", "x"), (6, "b", "z")]


def test_empty_index(spark):
    folder = new_folder(spark, "index")
    index.build(spark.createDataFrame([], SCHEMA), "id", FIELDS, folder, ["title"])
    assert index.search(index.opened(spark, folder), spark.createDataFrame(QUERIES, "q long, t string"), "q", "t").collect() == []


def test_search_text(spark):
    for t in ["１００ RMB，红色！！鞋", "99yuan 5cny5", "  a ,b|c\t\n人民币 块钱 ", None, "ẞ，", "100rmb。"]:
        got = spark.range(1).select(text.search_normal(F.lit(t).cast("string")).alias("n"), text.search_tokens(text.search_normal(F.lit(t).cast("string"))).alias("t")).first()
        assert got["t"] == tokens(t)
    assert spark.range(1).select(text.search_normal(F.lit("１００ RMB，红色！鞋"))).first()[0] == "100元 红色 鞋"
