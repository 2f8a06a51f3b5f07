"""Exact top-k search by inner product, a block at a time.

Vectors are dealt evenly to shards by a hash of their id; a shard orders its
vectors by halving along the widest dimension, so that neighbours in the order
are alike, and cuts the order into document-range blocks. A block has a forward
index (its vectors) and, for each term (dimension), the largest and smallest
weight. For a query, the sum over terms of the larger of q * max and q * min
bounds every score in the block. Blocks are taken by falling bound and scored
through their forward index until the next bound is below the k-th score; a bound
that equals it is still opened, for a smaller id may win the tie. Shard results
of at most k rows for each query meet in one ranking.

The stated queries are sent to every shard in batches of bounded size; no other
pair of rows is formed.

Before the search, a batch of queries meets one shard of its own; the k-th score
there is a floor for the whole search, so the other shards open only blocks whose
bound reaches it. A shard's index is read once and all batches stream past it.

Edge cases: vectors that are null, hold a null or a non-finite component take no
part, nor do rows with a null id; a shorter vector counts as padded with zeros;
repeated equal rows count once; of different vectors with one id the first in
order asks, and all can be found, but never by their own id. Scores are exact
whatever the size of the components; one that a long cannot hold raises
OverflowError, as does a component beyond a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage

#: Vectors in a shard, in a block, and queries in a batch.
SHARD, BLOCK, BATCH = 8192, 64, 1024
SCALE = 256
_NONE = np.iinfo(np.int64).min // 2


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id and v, floor(256 * x) of each component, of the rows that take part."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), x).filter(F.col("id").isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False)))
    scaled = lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double"))
    beyond = lambda c: F.abs(c.cast("double")) >= F.lit(2.0**63 / SCALE)
    return rows.select("id", F.transform(x, lambda c: F.when(beyond(c), F.raise_error(F.lit("a component beyond a long")).cast("long")).otherwise(scaled(c))).alias("v"))


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors, padded with zeros; equal rows once, in order of id and vector."""
    column = table.column("v").combine_chunks()
    ids = np.asarray(table.column("id"))
    sizes = np.asarray(column.value_lengths())
    values = np.asarray(column.flatten())
    small = not len(values) or (values.min() >= -(1 << 31) and values.max() < 1 << 31)
    x = np.zeros((len(ids), int(sizes.max()) if len(sizes) else 0), np.int32 if small else np.int64)
    x[np.arange(x.shape[1]) < sizes[:, None]] = values
    order = np.lexsort((*x.T[::-1], ids))
    ids, x = ids[order], x[order]
    fresh = np.ones(len(ids), bool)
    fresh[1:] = (ids[1:] != ids[:-1]) | (x[1:] != x[:-1]).any(axis=1)
    return ids[fresh], x[fresh]


def halved(x: np.ndarray, size: int) -> np.ndarray:
    """An order in which runs of `size` rows are alike: halve at the median of the widest dimension."""
    todo, out = [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        d = int(x[rows].astype(np.float64).var(axis=0).argmax()) if x.shape[1] else 0
        half = -(-len(rows) // (2 * size)) * size
        split = np.argsort(x[rows, d], kind="stable") if x.shape[1] else np.arange(len(rows))
        todo += [rows[split[half:]], rows[split[:half]]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class Index:
    """A shard: vectors in block order, with the largest and smallest weight by block and term."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, block: int = BLOCK):
        order = halved(x, block)
        self.ids, self.x, self.block = ids[order], x[order], block
        starts = np.arange(0, len(ids), block)
        self.high = np.maximum.reduceat(self.x, starts, axis=0) if len(ids) else self.x
        self.low = np.minimum.reduceat(self.x, starts, axis=0) if len(ids) else self.x

    def search(self, query_ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Scores and ids (queries x k, the score _NONE where there are fewer), and blocks opened.

        floor: for each query a score that k vectors are known to reach; what is below it may be left out.
        """
        d = max(self.x.shape[1], q.shape[1])
        pad = lambda m: np.pad(m, ((0, 0), (0, d - m.shape[1])))
        q, x, high, low = pad(q), pad(self.x), pad(self.high), pad(self.low)
        top = max((abs(int(m)) for m in (q.min(initial=0), q.max(initial=0))), default=0) * max((abs(int(m)) for m in (x.min(initial=0), x.max(initial=0))), default=0) * max(d, 1)
        # products that a double, or else a long, holds exactly; Python's numbers beyond
        kind = np.float64 if top < 1 << 53 else np.int64 if top < 1 << 62 else object
        q, x, high, low = (m.astype(kind) for m in (q, x, high, low))
        score = np.full((len(q), k), _NONE, np.int64)
        found = np.full((len(q), k), np.iinfo(np.int64).max, np.int64)
        floor = np.full(len(q), _NONE, np.int64) if floor is None else floor
        bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
        # a bound may exceed a long where the scores do not
        bound = np.clip(bound, -(1 << 62), 1 << 62).astype(np.int64)
        order = np.argsort(-bound, axis=1, kind="stable")
        live, opened = np.arange(len(q)), 0
        for step in range(bound.shape[1]):
            at = order[live, step]
            open_ = bound[live, at] >= np.maximum(score[live, k - 1], floor[live])
            live, at = live[open_], at[open_]
            if not len(live):
                break
            opened += len(live)
            by_block = np.argsort(at, kind="stable")
            for part in np.split(by_block, np.flatnonzero(np.diff(at[by_block])) + 1):
                rows, b = live[part], int(at[part[0]])
                span = slice(b * self.block, (b + 1) * self.block)
                s = q[rows] @ x[span].T
                if kind is object and s.size and max(abs(int(s.min())), abs(int(s.max()))) >= 1 << 62:
                    raise OverflowError("a score does not fit in a long")
                s = s.astype(np.int64)
                ids = np.broadcast_to(self.ids[span], s.shape)
                s = np.where(ids == query_ids[rows][:, None], _NONE, s)
                hit = s.max(axis=1) >= score[rows, k - 1]
                rows, s, ids = rows[hit], s[hit], ids[hit]
                if not len(rows):
                    continue
                s, ids = np.hstack([score[rows], s]), np.hstack([found[rows], np.where(s == _NONE, np.iinfo(np.int64).max, ids)])
                best = np.lexsort((ids, -s), axis=1)[:, :k]
                score[rows], found[rows] = np.take_along_axis(s, best, 1), np.take_along_axis(ids, best, 1)
        return score, found, opened


def _packed(df: DataFrame, key: str, floors: bool = False) -> DataFrame:
    """A row for each value of key: its ids and vectors as bytes, and floors where there are any."""

    def pack(table: pa.Table) -> pa.Table:
        ids, x = _matrix(table)
        if floors:  # one vector of an id asks
            first = np.concatenate([[True], ids[1:] != ids[:-1]])
            ids, x = ids[first], x[first]
            by_id = dict(zip(table.column("id").to_pylist(), table.column("floor").to_pylist()))
            floor = np.array([by_id[i] for i in ids.tolist()], np.int64).tobytes()
        else:
            floor = b""
        return pa.table({key: [table.column(key)[0].as_py()], "ids": [ids.tobytes()], "wide": [x.dtype == np.int64], "x": [x.tobytes()], "floors": [floor]})

    return df.groupBy(key).applyInArrow(pack, f"{key} long, ids binary, wide boolean, x binary, floors binary")


def _unpacked(r: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(r["ids"], np.int64)
    return ids, np.frombuffer(r["x"], np.int64 if r["wide"] else np.int32).reshape(len(ids), -1)


def _searched(index: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: of each (shard, batch) row of asked the best k of that shard.

    A shard's index comes first in its task, then its batches one after the other.
    """

    def run(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, None
        for chunk in chunks:
            for r in chunk.to_pylist():
                if r["batch"] < 0:
                    shard, held = r["shard"], Index(*_unpacked(r))
                    continue
                if r["shard"] != shard:
                    continue  # a shard without vectors
                ids, q = _unpacked(r)
                score, found, _ = held.search(ids, q, k, np.frombuffer(r["floors"], np.int64))
                real = score != _NONE
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k).reshape(-1, k)[real]), pa.array(found[real]), pa.array(score[real])], ["query_id", "vec_id", "score"])

    columns = ["shard", "batch", "ids", "wide", "x", "floors"]
    rows = index.withColumn("batch", F.lit(-1).cast("long")).select(*columns).unionByName(asked.select(*columns))
    return rows.repartition("shard").sortWithinPartitions("shard", "batch").mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score from tables of (id, v)."""
    shards = max(1, -(-candidates.count() // SHARD))
    batches = max(1, -(-queries.count() // BATCH))
    shard = F.pmod(F.xxhash64("id"), F.lit(shards))
    index = stage(_packed(candidates.withColumn("shard", shard), "shard"), "topk-index")
    dealt = queries.withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(batches)))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    none = F.lit(_NONE)
    if shards > 1:
        # a batch against the shard of its own number; a whole k found there is a floor for the search
        first = _packed(dealt.withColumn("floor", none), "batch", True).withColumn("shard", F.pmod("batch", F.lit(shards)))
        floors = ranked(_searched(index, first, k)).filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
        dealt = dealt.join(floors, "id", "left").withColumn("floor", F.coalesce("floor", none))
    else:
        dealt = dealt.withColumn("floor", none)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
    asked = stage(_packed(dealt, "batch", True), "topk-queries").withColumn("shard", every)
    return ranked(_searched(index, asked, k)).select("query_id", "rank", "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(rows, rows.filter(F.col("id") % 50 == 0), 5)


_SQL = """
WITH w AS (
  SELECT DISTINCT vec_id, [floor(256.0 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
v AS (SELECT vec_id, list_resize(e, (SELECT max(len(e)) FROM w), 0.0) AS e,
  row_number() OVER (PARTITION BY vec_id ORDER BY e) AS n FROM w),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0 AND q.n = 1),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

QUERIES = {"op1_topk": op1_topk}
ORACLE = {"op1_topk": _SQL}
