"""A stored multi-field BM25 index whose blocks carry the most a term can add, and exact top-k that skips blocks.

build() writes three tables and, last, a manifest that makes them visible:

* postings: a row for each term and range of documents that has it: the range's documents
  with what the term adds to each of them (idf apart);
* bounds: the same without documents: how many there are, and the most the term adds;
* terms: in how many documents a term is.

Documents stand in order of the columns given as cluster, so that a term's documents share
ranges. search() bounds every query and range by the sum of idf times these maxima,
scores the ranges with the highest bounds until k documents are certain, and then only
those ranges whose bound reaches the k-th score found. What is skipped cannot hold a better
document, so ranks are those of scoring everything.

A field's text counts as its distinct tokens; a token with marks inside (a-1) also counts as its parts, and
is a term of its own, so a query for it meets documents with just that token. Weights multiply
term frequencies; lengths are plain. idf is floored, so a term in most documents adds little but never subtracts.

Scale: tokens are moved once, by range, which serves both the sums by document and the
lists by term; a block has at most RANGE documents. Tables are sorted by term and cut by
term and range, so a frequent term spreads over files. Bounds are narrow rows. There is
no table that a task holds whole, and no state in the driver but the manifest.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import search_normal, search_tokens
from ..sources.files import content_digest, exists
from ..sources.shared import new_folder, written

VERSION, SCHEMA = "trailmill-multifield-bm25-1", 1
#: Weights of the fields, saturation and length normalisation, the least idf.
WEIGHTS = {"title": 3.0, "brand": 2.0, "category": 2.0, "model": 2.5, "attributes": 1.5, "options": 1.2, "bullets": 0.8}
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Documents of a range.
RANGE = 4096


class IndexFault(RuntimeError):
    """The index is absent, of another version or made from other rows."""


def checked(weights: dict[str, float]) -> dict[str, float]:
    """The weights, if there is one for each field and each is finite and positive."""
    if set(weights) != set(WEIGHTS):
        raise ValueError("there must be a weight for each of: " + ", ".join(WEIGHTS))
    if bad := [f for f, w in weights.items() if not (math.isfinite(w) and w > 0)]:
        raise ValueError(f"weights must be finite and positive: {', '.join(bad)}")
    return {f: float(weights[f]) for f in WEIGHTS}


def _parts(tokens: Column) -> Column:
    return F.filter(F.flatten(F.transform(tokens, lambda x: F.split(x, r"[._+\-/]"))), lambda x: x != "")


def _terms(text: Column, weight: float) -> tuple[Column, Column]:
    """Array of (term, weight) for every occurrence in a field, and the field's length."""
    # an array of one, so that tokens are worked out once for both lists
    split = F.transform(F.array(search_tokens(search_normal(text))), lambda t: F.struct(_parts(t).alias("parts"), F.filter(t, lambda x: x.rlike(r"[._+\-/]")).alias("whole")))
    both = F.get(split, F.lit(0))
    return F.transform(F.concat(both["parts"], both["whole"]), lambda x: F.struct(x.alias("term"), F.lit(weight).alias("w"))), F.size(both["parts"])


def products(docs: DataFrame, key: str, order: list[str]) -> DataFrame:
    """SNK8: rows with a usable key (a string that is neither empty nor nan), the first of each key in the given order."""
    clean = docs.withColumn("_key", F.trim(F.col(key).cast("string"))).filter((F.col("_key") != "") & (F.col("_key") != "nan"))
    rank = F.row_number().over(Window.partitionBy("_key").orderBy(*order))
    return clean.withColumn("_rank", rank).filter("_rank = 1").drop("_rank", "_key")


def build(docs: DataFrame, key: str, fields: dict[str, Column | str], folder: str, cluster: list[str], weights: dict[str, float] = WEIGHTS, size: int = RANGE) -> str:
    """SNK8: write the index of docs and return its digest. A new version appears at once; readers of the one before go on with it."""
    spark = docs.sparkSession
    weights = checked(weights)
    if set(fields) != set(weights):
        raise ValueError("there must be a column for each of: " + ", ".join(weights))
    version = uuid.uuid4().hex
    home = f"{folder}/{version}"
    near = [F.col(c).alias(f"_cluster{i}") for i, c in enumerate(cluster)]
    plain = docs.select(F.col(key).alias("key"), *near, *[(F.expr(c) if isinstance(c, str) else c).cast("string").alias(f"_{f}") for f, c in fields.items()])
    order = [*[f"_cluster{i}" for i in range(len(cluster))], "key"]
    place = F.monotonically_increasing_id()
    # a partition's number, then a row's range inside it; written, so that both stay what they are
    dealt = plain.repartitionByRange(*order).sortWithinPartitions(*order)
    # tokens are made once, behind the shuffle
    found = {f: _terms(F.col(f"_{f}"), weights[f]) for f in fields}
    dealt = dealt.select("*", F.concat(*[t for t, _ in found.values()]).alias("terms"), sum((n for _, n in found.values()), F.lit(0)).cast("long").alias("length"))
    ranged = written(dealt.select("key", "terms", "length", (F.shiftleft(F.shiftright(place, 33), 32) + F.floor(place.bitwiseAND(F.lit((1 << 33) - 1)) / size)).alias("range")), f"{home}/documents")
    n, total = ranged.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    average = total / n if n else 0.0
    norm = F.lit(K1) * (1 - B + (B * F.col("length") / F.lit(average) if average else F.lit(0.0)))
    moved = ranged.select("key", "range", "length", F.explode("terms").alias("x")).repartition(F.col("range"))
    frequency = moved.groupBy("range", "key", "length", F.col("x.term").alias("term")).agg(F.sum("x.w").alias("tf"))
    one = F.struct("key", (F.col("tf") * (K1 + 1) / (F.col("tf") + norm)).alias("adds"))
    blocks = frequency.groupBy("range", "term").agg(F.sort_array(F.collect_list(one)).alias("documents"))
    listed = blocks.select("term", "range", F.size("documents").alias("n"), F.array_max(F.transform("documents", lambda d: d["adds"])).alias("most"), "documents")
    postings = written(listed.repartitionByRange("term", "range").sortWithinPartitions("term", "range"), f"{home}/postings")
    bounds = written(postings.select("term", "range", "n", "most"), f"{home}/bounds")
    written(bounds.groupBy("term").agg(F.sum("n").alias("df")), f"{home}/terms")
    manifest = {"version": VERSION, "schema": SCHEMA, "tables": version, "documents": n, "length": total, "weights": weights, "source": content_digest(docs), "postings": content_digest(bounds), "range": size}
    _publish(spark, folder, manifest)
    return manifest["source"]


def _versions(spark: SparkSession, folder: str) -> list[int]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n.removeprefix("manifest-")) for n in names if n.startswith("manifest-"))


def _publish(spark: SparkSession, folder: str, manifest: dict) -> None:
    """A manifest is written beside and renamed to the next number; of two builders one fails."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    beside = f"{folder}/_{manifest['tables']}"
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(beside)
    to = path(f"{folder}/manifest-{(_versions(spark, folder) or [0])[-1] + 1}")
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(to) or not fs.rename(path(beside), to):
        raise IndexFault(f"{to} was published by another build")


@dataclass(frozen=True)
class Index:
    """An opened index."""

    manifest: dict
    postings: DataFrame
    bounds: DataFrame
    terms: DataFrame
    documents: DataFrame

    def contains(self, key) -> bool:
        return self.documents.filter(F.col("key") == F.lit(key)).limit(1).count() > 0


def opened(spark: SparkSession, folder: str, source: str | None = None, thorough: bool = False) -> Index:
    """SRC11: the newest index of a folder, refused if its version, its weights or the rows it was made from are others.

    thorough also reads the bounds and compares their digest.
    """
    numbers = _versions(spark, folder)
    if not numbers:
        raise IndexFault(f"there is no index in {folder}")
    try:
        manifest = json.loads(spark.read.text(f"{folder}/manifest-{numbers[-1]}").first()[0])
        weights = checked(manifest["weights"])
        tables = f"{folder}/{manifest['tables']}"
    except (ValueError, KeyError, TypeError) as e:
        raise IndexFault(f"the manifest of {folder} is broken: {e}") from e
    for what, want in (("version", VERSION), ("schema", SCHEMA)):
        if manifest.get(what) != want:
            raise IndexFault(f"the index has {what} {manifest.get(what)}, not {want}")
    if source is not None and manifest["source"] != source:
        raise IndexFault("the index was made from other rows")
    if lost := [t for t in ("postings", "bounds", "terms", "documents") if not exists(spark, f"{tables}/{t}/_SUCCESS")]:
        raise IndexFault(f"tables are missing: {', '.join(lost)}")
    read = {t: spark.read.parquet(f"{tables}/{t}") for t in ("postings", "bounds", "terms", "documents")}
    if thorough and content_digest(read["bounds"]) != manifest["postings"]:
        raise IndexFault("the index holds other bounds than were written")
    return Index(manifest | {"weights": weights}, **read)


def search(index: Index, queries: DataFrame, query_key: str, text: str, k: int = 150) -> DataFrame:
    """RET1, JN11, SRT1, WIN20: query, key, score, rank of the k best by (score, key), with opened and ranges: how many ranges were scored, of how many.

    A query without tokens, or whose tokens no document has, gets no rows; scores are rounded to 9 digits before ranking.
    """
    spark = queries.sparkSession
    if k <= 0:
        raise ValueError("k must be positive")
    n = index.manifest["documents"]
    home = new_folder(spark, "search")
    asked = queries.select(F.col(query_key).alias("query"), F.explode(search_tokens(search_normal(F.col(text)))).alias("term")).distinct()
    idf = F.greatest(F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    weighed = written(asked.join(index.terms, "term").select("query", "term", idf.alias("idf")), f"{home}/asked")
    bound = weighed.join(index.bounds, "term").groupBy("query", "range").agg((F.sum(F.col("idf") * F.col("most")) * (1 + 1e-12)).alias("bound"), F.max("n").alias("sure"))
    bound = written(bound, f"{home}/bounds")
    before = Window.partitionBy("query").orderBy(F.col("bound").desc(), "range").rowsBetween(Window.unboundedPreceding, -1)
    first = bound.withColumn("before", F.coalesce(F.sum("sure").over(before), F.lit(0))).filter(F.col("before") < k).select("query", "range", "bound")
    first = written(first, f"{home}/first")

    def best(scored: DataFrame, by: list[str]) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), "key"))
        return scored.withColumn("rank", rank).filter(F.col("rank") <= k)

    def scored(ranges: DataFrame) -> DataFrame:
        wanted = ranges.select("query", "range").join(weighed, "query")
        hits = wanted.join(index.postings.select("term", "range", "documents"), ["term", "range"]).select("query", "range", "idf", F.explode("documents").alias("d"))
        sums = hits.groupBy("query", "range", F.col("d.key").alias("key")).agg(F.round(F.sum(F.col("idf") * F.col("d.adds")), 9).alias("score"))
        return best(sums, ["query", "range"]).select("query", "range", "key", "score")

    top = written(scored(first), f"{home}/top")
    floor = best(top, ["query"]).filter(F.col("rank") == k).select("query", F.col("score").alias("floor"))
    more = bound.join(floor, "query", "left").filter(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - 1e-9)).join(first.select("query", "range"), ["query", "range"], "left_anti")
    more = written(more.select("query", "range", "bound"), f"{home}/more")
    counts = first.select("query").union(more.select("query")).groupBy("query").agg(F.count("*").alias("opened"))
    counts = counts.join(bound.groupBy("query").agg(F.count("*").alias("ranges")), "query")
    return best(top.union(scored(more)), ["query"]).select("query", "key", "score", "rank").join(counts, "query")
