"""Steps dealt by key: a task's rows must not grow with the input, and pairs that can be scored in place must not move."""

import re

import pytest

from trailmill.operators import reviews
from trailmill.registry import QUERIES
from trailmill.sources import files

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tasks_grow_with_the_input(spark, monkeypatch):
    lines = spark.read.parquet(f"{DIR}/lineitem.parquet")
    size = files.input_bytes(lines)
    assert size > 50_000
    monkeypatch.setattr(files, "TASK_BYTES", size // 9)
    assert files.dealt(lines, "l_orderkey").rdd.getNumPartitions() == 10
    monkeypatch.setattr(files, "TASK_BYTES", size)
    assert "REPARTITION_BY_NUM" not in plan(files.dealt(lines, "l_orderkey"))


@pytest.mark.parametrize("name, keys", [("metric_panel", "client_id day"), ("call_behaviour", "client_id day"), ("trajectory_behaviour", "user_id"), ("exact_cover_report", "l_orderkey"), ("bm25_topk", "doc_id"), ("retrieval_evidence", "doc_id")])
def test_queries_state_their_tasks(spark, monkeypatch, name, keys):
    monkeypatch.setattr(files, "TASK_BYTES", 256)
    stated = re.findall(r"hashpartitioning\(([^()]*), (\d+)\), REPARTITION_BY_NUM", plan(QUERIES[name](spark, DIR)))
    assert keys in {re.sub(r"#\d+L?,?", "", by) for by, _ in stated} and all(int(n) > 4 for _, n in stated)


@pytest.mark.parametrize("name", ["bm25_topk", "retrieval_evidence"])
def test_scores_stay_with_their_documents(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = plan(QUERIES[name](spark, DIR))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # neither the pairs of a query and a document nor the occurrences of tokens are shuffled; only the best of each task are
    assert not re.search(r"Exchange hashpartitioning\(item_id#\d+L?, doc_id", found)
    assert not re.search(r"Exchange hashpartitioning\(doc_id#\d+L?, token", found)
    assert "WindowGroupLimit" in found


def test_null_items_cover_nothing(spark):
    need = spark.createDataFrame([("a", None), ("a", 1), (None, 2)], "g string, i int")
    have = spark.createDataFrame([("a", None), ("a", None), ("a", 1), (None, 2)], "g string, i int")
    assert {tuple(r) for r in reviews.exact_cover(need, have, "g", "i").collect()} == {("a", 1, 1, 1), (None, 1, 1, 0)}
