"""Small literal cases for what the driver's tables do not show: nulls, tri-state logic, streams, files."""

import pytest
from pyspark.sql import functions as F

from trailmill.functions import scores, text
from trailmill.operators import checks, grpo, sampling, sequence
from trailmill.sources import files
from trailmill.streaming import tracker


def test_tri_state(spark):
    df = spark.createDataFrame([(None, None), (True, None), (True, False), (True, True), (False, True)], "v boolean, p boolean")
    assert [r[0] for r in df.select(scores.tri_state(F.col("v"), F.col("p"))).collect()] == ["unverifiable", "fail", "fail", "pass", "unverifiable"]


def test_advantage(spark):
    df = spark.createDataFrame([("a", 1.0, True), ("a", 0.0, True), ("a", 9.0, False), ("b", 1.0, True)], "g string, s double, ok boolean")
    got = [r["advantage"] for r in grpo.group_advantage(df, "g", "s", F.col("ok")).orderBy("g", F.col("s").desc()).collect()]
    assert got[0] == 0.0 and abs(got[1] - 0.5**0.5) < 1e-9 and abs(got[2] + 0.5**0.5) < 1e-9 and got[3] is None


def test_reasons_and_ladder(spark):
    df = spark.createDataFrame([(None,), (5,)], "x int")
    rule = ((F.col("x") > 3, "big"), (F.col("x") > 4, "huge"))
    assert [r[0] for r in df.select(checks.reasons(*rule)).collect()] == [[], ["big", "huge"]]
    assert [r[0] for r in df.select(checks.ladder(*rule, otherwise="ok")).collect()] == ["ok", "big"]


def test_flow_and_interleave():
    take = sampling.min_cost_flow({("a", "x"): 1, ("a", "y"): 1, ("b", "x"): 1}, {"a": 1, "b": 1}, 1)
    assert take == {("a", "x"): 0, ("a", "y"): 1, ("b", "x"): 1}
    assert sampling.interleave({"a": 2, "b": 1}) == ["a", "b", "a"]


def test_text(spark):
    df = spark.createDataFrame([("Ｆｕｌｌ　Straße!  x",), (None,)], "t string")
    assert [r[0] for r in df.select(text.query_normal(F.col("t"))).collect()] == ["full strasse x", None]
    han = spark.createDataFrame([("红色鞋 size-42 鞋",)], "t string").select(text.han_bigrams(F.col("t"))).first()[0]
    assert han == ["红色", "色鞋", "鞋", "size-42"]
    page = spark.createDataFrame([("<p>a</p><script>x</script><b>c</b>",)], "h string")
    assert page.select(text.visible_text("h")).first()[0] == "a c"


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    path = str(tmp_path / "t")
    assert files.freeze(df, path) == "written" and files.freeze(df.orderBy(F.desc("id")), path) == "unchanged"
    with pytest.raises(ValueError):
        files.freeze(df.limit(1), path)
    assert files.read_jsonl(spark, str(tmp_path / "none"), df.schema).count() == 0
    (tmp_path / "x.jsonl").write_text('{"id": 1, "v": "a"}\nnot json\n')
    assert files.read_jsonl(spark, str(tmp_path / "x.jsonl"), df.schema, tolerant=True).count() == 1
    log = spark.createDataFrame([(0, "\x1b[1mstep:1 loss:0.5"), (1, "step:1 loss:np.float64(0.25)"), (2, "noise")], "n long, line string")
    assert files.parse_log(log, "line", "n", ["loss"]).collect()[0]["loss"] == 0.25


def test_tracker_stream_equals_batch(spark, tmp_path):
    rows = [("s", i, sig, ev) for i, (sig, ev) in enumerate([("a", "1"), ("b", "2"), ("b", None), ("b", None)])] + [("t", i, f"x{i}", None) for i in range(6)]
    steps = spark.createDataFrame(rows, "session string, step long, signature string, evidence string")
    steps.write.parquet(str(tmp_path / "in"))
    q = tracker.track(spark.readStream.schema(steps.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("tracked").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    want = {("s", 4, "repeat_loop"), ("t", 4, "no_progress")}
    assert {tuple(r) for r in spark.table("tracked").collect()} == want == {tuple(r) for r in tracker.track_batch(steps).collect()}


def test_first_per_key_ties(spark):
    df = spark.createDataFrame([(1, 2), (1, 1), (None, 5)], "k int, o int")
    assert {(r["k"], r["o"]) for r in sequence.first_per_key(df, ["k"], ["o"]).collect()} == {(1, 1), (None, 5)}


def test_containing_finds_items_at_any_character(spark):
    from trailmill.operators import checks

    texts = [(1, "xalpha beta  gamma delta epsilonx"), (2, "alpha beta gamma"), (3, "no"), (4, ""), (5, None), (6, "n o  beta"), (7, "beta gamma delta epsilon " * 300 + "tail end"), (1, "alpha beta  gamma delta epsilon")]
    items = [("a", "alpha beta  gamma delta epsilon"), ("b", "beta gamma"), ("c", "o"), ("d", ""), ("e", None), ("f", " beta "), ("g", "silon tail end"), ("h", "beta  gamma d"), ("i", "absent words in here"), ("j", "a b c"), ("k", "n o  beta")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {tuple(r) for r in checks.containing(docs, "doc_id", "text", spark.createDataFrame(items, "item_id string, item string"), "item_id", "item", head=4, chunk=16).collect()}
    assert got == {(d, i) for d, text in texts for i, item in items if text and item and item in text}
    assert checks.containing(docs, "doc_id", "text", spark.createDataFrame([], "item_id string, item string"), "item_id", "item").count() == 0


def test_bm25_equals_the_formula(spark):
    import math
    import re

    from trailmill.operators import retrieval

    rows = [(1, "Red lamp", "lamp lamp x1"), (2, "blue", None), (3, None, "red red red blue"), (4, "", "--"), (5, "Red lamp", "lamp lamp x1")]
    asked = [("q", "red LAMP red"), ("r", "blue x1"), ("s", "nothing"), ("t", None)]
    weights = {"title": 3.0, "body": 1.0}
    bags = {}
    for key, *texts in rows:
        bag = bags.setdefault(key, {})
        for text, w in zip(texts, weights.values()):
            for token in re.findall("[a-z0-9]+", (text or "").lower()):
                bag[token] = bag.get(token, 0) + w
    bags = {k: v for k, v in bags.items() if v}
    mean = sum(sum(b.values()) for b in bags.values()) / len(bags)
    want = set()
    for name, text in asked:
        scores = []
        for key, bag in bags.items():
            terms = set(re.findall("[a-z0-9]+", (text or "").lower())) & set(bag)
            df = {x: sum(x in b for b in bags.values()) for x in terms}
            score = sum(math.log(1 + (len(bags) - df[x] + 0.5) / (df[x] + 0.5)) * bag[x] * 2.2 / (bag[x] + 1.2 * (0.25 + 0.75 * sum(bag.values()) / mean)) for x in terms)
            scores += [(-round(score, 6), key)] if terms else []
        want |= {(name, key, -s, i + 1) for i, (s, key) in enumerate(sorted(scores)[:2])}
    docs = spark.createDataFrame(rows, "id long, title string, body string")
    got = retrieval.bm25(docs, "id", weights, spark.createDataFrame(asked, "qid string, text string"), "qid", "text", 2)
    assert {tuple(r) for r in got.select("qid", "id", "score", "rank").collect()} == want
