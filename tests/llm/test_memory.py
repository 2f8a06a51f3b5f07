"""What a Python worker holds between tasks, and at once."""

import random
import re
import sys

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from trailmill.llm import common, jaccard, mixing, pieces, pii, toxicity

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def own_mb() -> float:
    """MB of this process without mapped files."""
    with open("/proc/self/smaps_rollup") as f:
        return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", f.read()))) / 1024


@pytest.mark.skipif(not sys.platform.startswith("linux") or common._trim is None, reason="needs /proc and malloc_trim")
def test_a_task_gives_freed_memory_back():
    def run(batches):
        held = [bytes(2000) for _ in range(100_000)]
        last.append(held[-1])  # what stands last keeps the library from giving back the rest
        yield from batches

    last: list[bytes] = []
    before = own_mb()
    assert len(list(common.lean(run)(iter([pa.record_batch({"x": [1]})])))) == 1
    assert own_mb() - before < 60


def test_a_worker_keeps_the_memory_of_one_operator_only():
    model = pieces.pieces(MODEL)
    list(common.lean(lambda batches: batches, keeps=True)(iter([])))
    assert pieces.pieces(MODEL) is model
    list(common.lean(lambda batches: batches)(iter([])))
    assert not common.REMEMBERED


@pytest.mark.parametrize("operator", ["toxicity", "pii", "pieces"])
def test_batches_of_a_table_that_the_caller_writes_are_bounded(spark, operator):
    def largest(batches):
        for b in batches:
            yield pa.record_batch({"mb": [b.nbytes / 1e6]})

    docs = spark.range(64).select(F.col("id").alias("doc_id"), F.repeat(F.lit("abc d "), 50_000).alias("text")).coalesce(1)
    before = spark.conf.get(common.BATCHES)
    try:
        spark.conf.set(common.BATCHES, str(256 << 20))
        if operator == "toxicity":
            toxicity.reject(docs, toxicity.Model(None, None, 0.0, None, None, False))
        elif operator == "pii":
            pii.redacted(docs)
        else:
            pieces.encode(docs.limit(2), MODEL)
        # 19 MB of text in one task, as the operator's own table would be sent
        assert docs.mapInArrow(largest, "mb double").agg(F.max("mb")).first()[0] < 1.5 * common.BATCH_BYTES / 1e6
    finally:
        spark.conf.set(common.BATCHES, before)


def test_a_smaller_bound_of_the_session_stays(spark):
    before = spark.conf.get(common.BATCHES)
    try:
        for given, wanted in (("1024", "1024"), (str(1 << 30), str(common.BATCH_BYTES)), ("64m", str(common.BATCH_BYTES))):
            spark.conf.set(common.BATCHES, given)
            common.bound_batches(spark)
            assert spark.conf.get(common.BATCHES) == wanted
    finally:
        spark.conf.set(common.BATCHES, before)


def test_links_are_the_same_by_lean_tasks(spark):
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words), " ".join(words[:-1]), " ".join(words[::-1]), "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["component_id"] for r in jaccard.duplicates(docs, 5, 80, 100).orderBy("doc_id").collect()] == [0, 0, 2, 3, 4]


def test_the_mix_moves_a_text_once(spark):
    rows = [(None if i % 9 == 0 else i, f"one two {i % 4}", "ab"[i % 2], i) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
        texts = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line and "none" in line]
        assert len(texts) == 2, plan  # the documents, and their numbers of copies
        assert not [line for line in plan.split("\n") if "Exchange hashpartitioning(id" in line and "none" not in line]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("of", ["operator", "pipeline"])
def test_a_group_does_not_travel_with_its_pairs(spark, of):
    """Texts with one passage in common make a group (here of 177 sets, first in its pairs), each of whose sets has a partner in a group of its own."""
    rng = random.Random(10)
    word = lambda: f"w{rng.randrange(1 << 40):x}"
    passage, rows = [word() for _ in range(22)], []
    for i in range(700):
        own = [word() for _ in range(100)]
        rows += [(i, " ".join(passage + own)), (i + 1000, " ".join(own))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    moved = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = moved()
    with common.settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}):
        if of == "operator":
            assert {r["doc_id"]: r["component_id"] for r in jaccard.duplicates(docs, 5, 80, 100).collect()} == {i: i % 1000 for i, _ in rows}
        else:
            assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == list(range(700))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    text = sum(len(t) for _, t in rows)
    assert moved() - before < 10 * text  # 31 times the text when a group went along with each of its pairs


def test_a_part_of_a_group_is_the_group_of_its_sets():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 300, n).astype(np.uint64)) for n in (1, 5, 40, 90, 90, 200)]
    group = jaccard.Group(*jaccard._group(sets))
    for on in ([2], [0, 1, 5], [1, 3, 4, 5]):
        part = jaccard.Group(*group.some(np.array(on)))
        assert [x.tolist() for x in part.sets()] == [sets[i].tolist() for i in on]
    tokens = group.union[::7]
    assert [h.tolist() for h in group.holders(tokens)] == [[i for i, x in enumerate(sets) if t in x] for t in tokens]


def test_links_over_several_lists_of_what_is_wanted(spark, monkeypatch):
    """A group opened for a few rows at once gives the links of all pairs."""
    monkeypatch.setattr(jaccard, "WANTED", 3)
    rng = random.Random(8)
    base, data = [f"w{i}" for i in range(60)], []
    for i in range(40):
        w = base[:]
        for _ in range(rng.randrange(7)):
            w[rng.randrange(60)] = f"n{rng.randrange(30)}"
        data.append((i, " ".join(w)))
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(56)} for i, t in data}
    root = {i: i for i in sets}
    for _ in range(8):
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = jaccard.duplicates(spark.createDataFrame(data, "doc_id long, text string"), 5, 80, 100).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == root


def test_counted_buckets_follow_the_text(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.repeat(F.lit("abc d "), 1000).alias("text"))
    assert common.buckets_for(docs, most=6000) == 40 and common.buckets_for(docs) == common.partitions(spark)
    assert jaccard.COUNTED_BYTES <= 32 << 20
