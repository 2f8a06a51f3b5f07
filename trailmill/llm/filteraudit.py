"""Filter interaction audit: what each filter removes at each place of every order of filters.

Every document gets a mask with a bit for each filter that it fails; the audit needs
only the counts of masks by part. One filter is table-wide: a text that a smaller
doc_id has too. Duplicates are found by partition refinement: documents are split by
their length in code points, then by the hashes of successive blocks of the text
(BLOCKS bytes, then the rest), and a document that is alone in its class goes at every
step. The full texts of those left are compared, and every document but the one with the
smallest doc_id of its text is marked.

Scale: lengths, block hashes and the other filters come from one scan, where the texts
are. Refinement moves narrow rows; a class is counted before it is moved, and the
classes with several rows are written, so that Spark splits the join where one class
has a third of all rows. Only texts of surviving classes are moved (a Bloom filter over their ids
drops the others first), and copies of a text are one before they meet. If texts of
one class differ, which takes equal hashes, its documents are judged text by text.
Masks are counted before they are moved; a part has 32 of them at most, and the
orders are set out from these counts.

Edge cases: a null text counts as empty, a null lang as the empty part; empty texts are
copies of each other; a null doc_id is not smaller than any other, nor the other
than it, so it fails no duplicate filter; repeated rows of the smallest doc_id do not
fail, as no smaller id has the text; a document is good or toxic if any of its label rows says so;
an empty table has no parts and gives no rows; extra columns, whatever their names, are cut first.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, settings, slices, stage

FILTERS = "ABCDE"
#: Bytes of the blocks after which classes are split; the last block is the rest of the text.
BLOCKS = (256, 4096, 65536)
KEYS = ["length", *[f"block{i}" for i in range(len(BLOCKS) + 1)]]
_UPPER = bytes(range(65, 91))
_SYMBOLS = b"#$%&*|"


def failures(text: str, raw: bytes) -> int:
    """Bits of the filters A to D that a text fails: few words, few distinct words, many capitals, symbols."""
    words = raw.split()
    few = len(words) < 100
    same = 100 * len(set(words)) < 80 * len(words)
    loud = 100 * (len(raw) - len(raw.translate(None, _UPPER))) > 10 * len(text)
    odd = len(raw) != len(raw.translate(None, _SYMBOLS))
    return few + 2 * same + 4 * loud + 8 * odd


def block_hashes(raw: bytes, bits: int = 64) -> list[int]:
    """A hash for each of the successive blocks; 0 for a block beyond the end."""
    out, start = [], 0
    for size in (*BLOCKS, max(1, len(raw))):
        block = raw[start : start + size]
        h = xxhash.xxh3_64_intdigest(block) & ((1 << bits) - 1) if block else 0
        out.append(h - (1 << 64) if h >> 63 else h)
        start += size
    return out


def scanned(docs: DataFrame, bits: int = 64) -> DataFrame:
    """doc_id, part, text, fails (bits of A to D), length and block hashes of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                rows = []
                for t in b.column("text").to_pylist():
                    t = t or ""
                    raw = t.encode("utf-8", "surrogatepass")
                    rows.append((failures(t, raw), len(t), *block_hashes(raw, bits)))
                made = np.array(rows, np.int64).reshape(len(rows), -1).T
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made[0].astype(np.int32)), *[pa.array(x) for x in made[1:]]], [*b.schema.names, "fails", *KEYS])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), "text")
    return plain.mapInArrow(run, "doc_id long, part string, text string, fails int, " + ", ".join(f"{k} long" for k in KEYS))


def refined(scan: DataFrame) -> DataFrame:
    """Staged rows (doc_id, keys) that share length and all block hashes with another row."""
    left = scan.filter("doc_id IS NOT NULL").select("doc_id", *KEYS)
    for i in range(len(KEYS)):
        by = KEYS[: i + 1]
        several = stage(left.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 1").select(*by), "audit-classes")
        left = stage(left.join(several, by, "left_semi").select("doc_id", *KEYS), "audit-left")
    return left


def copies(docs: DataFrame, bits: int = 64) -> DataFrame:
    """doc_id, part, fails and copy (whether a smaller doc_id has the same text) of every row."""
    scan = stage(scanned(docs, bits).drop("text"), "audit-scan")
    left = refined(scan)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    met = texts.join(left.filter("length > 0"), (F.col("id") == F.col("doc_id")) & (F.char_length("text") == F.col("length")))
    same = met.groupBy(*KEYS, "text").agg(F.min("doc_id").alias("first")).drop("text").groupBy(*KEYS).agg(F.count("*").alias("texts"), F.min("first").alias("first"))
    empty = left.filter("length = 0").groupBy(*KEYS).agg(F.lit(1).cast("long").alias("texts"), F.min("doc_id").alias("first"))
    # a Bloom filter of bounded size over the ids that are left drops other texts before their shuffle
    with settings(docs.sparkSession, {"spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0"}):
        classes = stage(same.union(empty), "audit-compared")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("copy")
    several = classes.filter("texts > 1").select(*KEYS)
    if not several.limit(1).count():
        return scan.join(classes.select(*KEYS, "first"), KEYS, "left").select("doc_id", "part", "fails", copy)
    # texts of one class that differ, or an id with two texts of one length: their rows are judged text by text
    out = scan.join(classes.filter("texts = 1").select(*KEYS, "first"), KEYS, "left").join(several, KEYS, "left_anti").select("doc_id", "part", "fails", copy)
    rows = stage(scanned(docs, bits).join(several, KEYS, "left_semi"), "audit-apart")
    first = rows.groupBy(*KEYS, "text").agg(F.min("doc_id").alias("first"))
    return out.union(rows.join(first, [*KEYS, "text"]).select("doc_id", "part", "fails", copy))


def audit(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The audit of masks (part, mask, n, good, toxic: rows counted by part and mask); bit i of a mask stands for filter i."""
    orders = ["".join(p) for p in permutations(filters)]
    bit = lambda i: f"shiftleft(1, instr('{filters}', substring(filter_order, {i}, 1)) - 1)"
    # an own filter is the first to act among the k that a mask fails in one of k orders
    shapley = f"CAST(c.n * {len(orders)} DIV bit_count(c.mask) AS LONG)"
    found = masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))
    places = found.withColumn("filter_order", F.explode(F.array(*[F.lit(o) for o in orders]))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))
    places = places.withColumn("own", F.expr(bit("step"))).withColumn("before", F.expr(f"aggregate(sequence(1, {len(filters)}), 0, (m, i) -> m + IF(i < step, {bit('i')}, 0))"))
    total = lambda what, when: F.expr(f"aggregate(counts, 0L, (s, c) -> s + IF({when}, {what}, 0L))")
    removed = "c.mask & own != 0 AND c.mask & before = 0"
    return places.select(
        "part",
        "filter_order",
        "step",
        total("c.n", "c.mask & (before | own) = 0").alias("kept"),
        total("c.n", removed).alias("removed"),
        total("c.n", "c.mask & own != 0 AND c.mask & before != 0").alias("redundant"),
        total("c.n", "c.mask = own").alias("unique_fails"),
        total("c.good", removed).alias("good_lost"),
        total("c.toxic", removed).alias("toxic_lost"),
        total(shapley, "c.mask & own != 0").alias("shapley"),
    )


def masks(docs: DataFrame, labels: DataFrame, bits: int = 64) -> DataFrame:
    """part, mask, n, good, toxic: rows of docs counted by part and by the filters they fail."""
    marked = copies(docs, bits).select("doc_id", "part", (F.col("fails") + F.when(F.col("copy"), 16).otherwise(0)).alias("mask"))
    says = lambda c: F.max((F.col(c) == 1).cast("long")).alias(c)
    told = labels.groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(says("quality"), says("toxic"))
    met = marked.join(told, F.col("doc_id") == F.col("labelled"), "left")
    return met.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum(F.coalesce("quality", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))


def op13_filteraudit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(masks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")))


_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM docs),
f AS (SELECT part,
        len(words) < 100 AS a,
        100 * len(list_distinct(words)) < 80 * len(words) AS b,
        100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) AS c,
        regexp_matches(t, '[#$%&*|]') AS d,
        coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e,
        (doc_id IS NOT NULL AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL))::INT AS good,
        (doc_id IS NOT NULL AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL))::INT AS toxic
      FROM w),
m AS (SELECT part, ['A', 'B', 'C', 'D', 'E'] AS names, [a, b, c, d, e] AS fails, a::INT + b::INT + c::INT + d::INT + e::INT AS n_fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT [l1.x, l2.x, l3.x, l4.x, l5.x] AS seq FROM l l1, l l2, l l3, l l4, l l5
      WHERE len(list_distinct([l1.x, l2.x, l3.x, l4.x, l5.x])) = 5),
x AS (SELECT m.*, o.seq, least(CASE WHEN fails[list_position(names, seq[1])] THEN 1 END, CASE WHEN fails[list_position(names, seq[2])] THEN 2 END,
             CASE WHEN fails[list_position(names, seq[3])] THEN 3 END, CASE WHEN fails[list_position(names, seq[4])] THEN 4 END,
             CASE WHEN fails[list_position(names, seq[5])] THEN 5 END) AS first_fail FROM m, o),
s AS (SELECT part, array_to_string(seq, '') AS filter_order, k AS step, seq[k] AS own,
        sum(CASE WHEN first_fail IS NULL OR first_fail > k THEN n ELSE 0 END)::BIGINT AS kept,
        sum(CASE WHEN first_fail = k THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN fails[list_position(names, seq[k])] AND first_fail < k THEN n ELSE 0 END)::BIGINT AS redundant,
        sum(CASE WHEN fails[list_position(names, seq[k])] AND n_fails = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN first_fail = k THEN good ELSE 0 END)::BIGINT AS good_lost,
        sum(CASE WHEN first_fail = k THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
      FROM x, (SELECT unnest([1, 2, 3, 4, 5])::INT AS k) GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM s
"""

QUERIES = {"op13_filteraudit": op13_filteraudit}
ORACLE = {"op13_filteraudit": _SQL}
