"""Mixing sources to target weights by systematic sampling.

A source's expected copies for each of its documents is target / source size.
Documents of a source stand in order of size, then doc_id; with prefix sums of
the expected copies and one random offset u, a document is emitted once for
each integer that its interval (S - r + u, S + u] crosses. r and u are multiples of
2**-32 and the crossings are counted in integers, so a document whose r is at
most 2 is emitted at most twice, at any rank. The order by size
spreads the draws evenly over short and long documents, so the words taken come
near the target. As all documents of a source expect the same r, the prefix sum
is r times the rank.

Scale: ranks come from a range-partitioned table of (source, size, doc_id): each
partition counts by source, and a table with a row for each partition and source
gives the offsets. A source with a third of all rows is spread over partitions
like any other; no window ever holds a source. Texts are read natively; the mix
itself moves each text once, to meet its number of copies. The table of sources,
a row for each, is ordered in one task.

Edge cases: a null text has size 0; a null source is a source of its own, last
in the order; a source without words has target 0 and is not taken; repeated
rows are ranked one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, lean, partitions, stage

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: Words to take for each word there is, and the most a source or document may repeat.
SHARE, MOST = 1.5, 2.0
SEED = "mix-1"
#: Unit of rates and offsets.
ONE = 1 << 32


def words_in(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A key without null whose order is by code point, null last."""
    return F.coalesce(F.concat(F.lit("0"), source), F.lit("1"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """key, source_size, target, rate, offset for each source.

    Shares by weight, cut at most * size, with the excess shared again until
    none is above, end at min(cap, level * weight) for one level. Sources ordered
    by cap / weight are cut first, so prefix sums over this table (a row for each
    source) find the level.
    """
    total = sized.groupBy("key").agg(F.sum("size").cast("double").alias("source_size"))
    order = Window.orderBy("key")
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), "key")
    all_rows = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int")
    w = total.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), turn + 1)).withColumn("cap", F.lit(most) * F.col("source_size"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    w = (
        w.withColumn("wanted", F.lit(share) * F.sum("source_size").over(all_rows))
        .withColumn("weights", F.sum("weight").over(all_rows))
        .withColumn("cut_cap", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("cut_weight", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("wanted") - F.col("cut_cap")) / (F.col("weights") - F.col("cut_weight")))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    )
    final = F.min(F.when(F.col("fits"), F.struct(F.col("cut_weight"), F.col("level")))).over(all_rows)["level"]
    w = w.withColumn("target", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least(F.col("cap"), final * F.col("weight"))))
    first8 = F.conv(F.substring(F.md5(F.concat(F.lit(SEED + ":"), F.col("key")).cast("binary")), 1, 8), 16, 10).cast("double")
    return w.select(
        "key",
        F.col("source_size").cast("long").alias("source_size"),
        "target",
        F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.col("target") / F.col("source_size")).alias("rate"),
        (first8 / F.lit(4294967296.0)).alias("offset"),
    )


def _local_ranks(sized: DataFrame) -> DataFrame:
    """Range-partitioned rows with partition number and rank inside partition and source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        part = TaskContext.get().partitionId()
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column("key")
            codes = pc.dictionary_encode(keys)
            index = np.asarray(codes.indices)
            rank = np.empty(len(index), np.int64)
            for code, key in enumerate(codes.dictionary.to_pylist()):
                at = np.flatnonzero(index == code)
                base = seen.get(key, 0)
                rank[at] = base + 1 + np.arange(len(at))
                seen[key] = base + len(at)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(index), part, np.int64)), pa.array(rank)], [*b.schema.names, "part", "local_rank"])

    dealt = sized.repartitionByRange(partitions(sized.sparkSession), "key", "size", "doc_id").sortWithinPartitions("key", "size", "doc_id")
    schema = ", ".join(f"{c} {t}" for c, t in sized.dtypes) + ", part long, local_rank long"
    return dealt.mapInArrow(lean(run), schema)


def copies(docs: DataFrame) -> DataFrame:
    """doc_id, key, size, source_size, target, copies for every row of docs."""
    sized = stage(docs.select("doc_id", source_key(F.col("source")).alias("key"), words_in(F.col("text")).alias("size")), "mix-sizes")
    ranked = stage(_local_ranks(sized), "mix-ranks")
    counts = ranked.groupBy("part", "key").agg(F.max("local_rank").alias("n"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n").join(targets(sized), "key")
    return ranked.join(starts, ["part", "key"]).select("doc_id", "key", "size", "source_size", "target", crossings(F.col("before") + F.col("local_rank")).alias("copies"))


def crossings(rank: Column) -> Column:
    """Integers in (rate (rank - 1) + offset, rate rank + offset], rate and offset being multiples of 2**-32.

    The whole part of rate always counts; its fraction f adds one where it carries:
    the fraction of rate rank + offset is then below f. That fraction needs the
    product's low 32 bits only, taken from two halves of the rank.
    """
    fixed = F.floor(F.col("rate") * F.lit(float(ONE))).cast("long")
    start = F.floor(F.col("offset") * F.lit(float(ONE))).cast("long")
    f, low = fixed.bitwiseAND(F.lit(ONE - 1)), F.lit(0xFFFF)
    high = (f * F.shiftright(rank, 16).bitwiseAND(low)).bitwiseAND(low)
    now = (f * rank.bitwiseAND(low) + F.shiftleft(high, 16) + start).bitwiseAND(F.lit(ONE - 1))
    return (F.shiftright(fixed, 32) + F.when(now < f, 1).otherwise(0)).cast("long")


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken, with the columns of docs, whatever their names."""
    names = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    doc_id, source, text = (F.col(f"c{names.index(c)}") for c in ("doc_id", "source", "text"))
    # plain keys without null: the window below then stands on the join's own shuffle, and a text moves once
    zero, keys = F.lit(0).cast(docs.schema["doc_id"].dataType), ["id", "none", "k", "s"]
    keyed = plain.withColumns({"id": F.coalesce(doc_id, zero), "none": doc_id.isNull(), "k": source_key(source), "s": words_in(text)})
    drawn = copies(docs).groupBy("doc_id", "key", "size").agg(F.sum("copies").alias("total"), F.count("*").alias("rows"))
    drawn = drawn.filter("total > 0").select(F.coalesce("doc_id", zero).alias("id"), F.col("doc_id").isNull().alias("none"), F.col("key").alias("k"), F.col("size").alias("s"), "total", "rows")
    joined = keyed.join(drawn, keys)
    # equal ids, sources and sizes share their draws evenly; nearly always there is one such row
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(text))
    each = F.floor(F.col("total") / F.col("rows")) + F.when(F.col("nth") <= F.col("total") % F.col("rows"), 1).otherwise(0)
    out = joined.withColumn("nth", nth).withColumn("n", each.cast("int")).filter("n > 0")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(documents(spark, sf_dir).select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


_SQL = f"""
WITH sized AS (
  SELECT doc_id, coalesce('0' || source, '1') AS key,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
total AS (SELECT key, sum(size)::DOUBLE AS source_size FROM sized GROUP BY key),
w AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY key) - 1) % 3 + 1)::INT]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM total),
v AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS wanted, sum(weight) OVER () AS weights,
        coalesce(sum(cap) OVER b, 0.0) AS cut_cap, coalesce(sum(weight) OVER b, 0.0) AS cut_weight
      FROM w WINDOW b AS (ORDER BY cap / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (wanted - cut_cap) / (weights - cut_weight) AS level FROM v),
f AS (SELECT arg_min(level, cut_weight) AS level FROM l WHERE level * weight <= cap),
t AS (SELECT key, source_size::BIGINT AS source_size,
        CASE WHEN source_size = 0 THEN 0.0::DOUBLE ELSE least(cap, (SELECT level FROM f) * weight) END AS target,
        (('0x' || substr(md5('{SEED}:' || key), 1, 8))::BIGINT)::DOUBLE / 4294967296.0::DOUBLE AS u FROM l),
r AS (SELECT s.doc_id, s.size, t.source_size, t.target, t.u,
        CASE WHEN t.source_size = 0 THEN 0.0::DOUBLE ELSE t.target / t.source_size::DOUBLE END AS rate,
        row_number() OVER (PARTITION BY key ORDER BY s.size, s.doc_id) AS k FROM sized s JOIN t USING (key)),
i AS (SELECT *, floor(rate * {ONE}.0::DOUBLE)::HUGEINT AS f, floor(u * {ONE}.0::DOUBLE)::HUGEINT AS o FROM r)
SELECT doc_id, size, source_size, target,
  (((f * k + o) // {ONE} - (f * (k - 1) + o) // {ONE}) * size)::BIGINT AS taken FROM i
"""

QUERIES = {"op4_mixing": op4_mixing}
ORACLE = {"op4_mixing": _SQL}
