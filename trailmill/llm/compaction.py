"""Compaction of small files by first-fit decreasing, carried out on Parquet files.

A table is written as one sorted file for each piece of a lot of a day, then the
small files of a day are packed into groups and each group of several becomes one
file. Packing is first fit over a Fenwick tree: a residual is compressed to the
number of distinct sizes that still fit in it, a node keeps a heap of the groups
below it whose stale entries go when they reach the top, and a suffix minimum over
the places from a file's size on is the earliest group with room.

Scale: the number of files does not follow the rows. A day of r rows in a table of
R has 1 + floor(r / S) lots with S = 1 + floor(R / 150) and four pieces a lot, so
there are at most 4 (days + 150) files: their names may go through the driver, as
they do in any listing, and are joined as a small table. Rows are dealt to one
task a file (a contract's whole file), which sorts with spill and streams it out; a
hot day is cut in lots before that. Only files that join a group are read again.
Digests are made from the final files by tasks that stream the sorted ids of one
file after the other. The table of days, a row for each calendar day, is broadcast
while it has at most DAYS rows and joined by shuffle beyond.

Lost executors and stops: files come by Spark's committer. Merged files are
written beside the folder, counted, moved in, and only then are their sources
deleted; the plan is staged first, and finish() may run again at any point after it.

Edge cases: a null day is a day of its own (its rows' day is null) and a null id
counts as the empty text, in its crc32 and in the digest of ids; rows that tie on
time and id may stand in either order; repeated rows are kept one by one; a value
that is null, not finite or beyond 62 bits of cents counts 0 cents; an empty table gives
a folder without data files and no rows; extra columns are written as they are and
columns of any name are kept, as the table's columns go by position.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import STAGING, settings, stage, stage_path

#: Shares of the table that a lot, a small file and a group are measured by; pieces of a lot.
LOT, SMALL, FULL, PIECES = 150, 600, 500, 4
#: Rows up to which the table of days is broadcast.
DAYS = 100_000


class FirstFit:
    """Groups of bounded capacity; place() puts an item into the earliest group that has room."""

    def __init__(self, sizes: list[int], capacity: int):
        self.capacity = capacity
        self.levels = sorted(set(sizes))
        self.nodes: list[list[tuple[int, int]]] = [[] for _ in range(len(self.levels) + 1)]
        self.room: list[int] = []
        self.at: list[int] = []

    def _level(self, residual: int) -> int:
        """Place of a residual from the top: 1 if every size fits, one more for each size that does not."""
        return len(self.levels) - bisect_right(self.levels, residual) + 1

    def _enter(self, group: int) -> None:
        level = self._level(self.room[group])
        if self.at[group] == level:
            return
        self.at[group] = i = level
        while i < len(self.nodes):
            heappush(self.nodes[i], (group, level))
            i += i & -i

    def _earliest(self, size: int) -> int | None:
        """Smallest group among the places where the size still fits."""
        best, i = None, len(self.levels) - bisect_left(self.levels, size)
        while i > 0:
            heap = self.nodes[i]
            while heap and self.at[heap[0][0]] != heap[0][1]:
                heappop(heap)
            if heap and (best is None or heap[0][0] < best):
                best = heap[0][0]
            i -= i & -i
        return best

    def place(self, size: int) -> int:
        """The item's group, a new one if none has room; an item above the capacity fills a group alone."""
        group = self._earliest(size)
        if group is None:
            group = len(self.room)
            self.room.append(self.capacity)
            self.at.append(0)
        self.room[group] -= size
        self._enter(group)
        return group


def packed(files: DataFrame, small: int, capacity: int) -> DataFrame:
    """name, leader, place, members of every small file of files (name, part, n_rows, lot, piece).

    Files of a part below small rows are taken by falling rows, then lot, then piece; leader is the name of the first
    file of its group, place counts from 0 inside it.
    """

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_rows", "lot", "piece", "name"], ascending=[False, True, True, True], kind="stable")
        sizes = [int(x) for x in pdf["n_rows"]]
        fit = FirstFit(sizes, capacity)
        pdf = pdf.assign(group=[fit.place(s) for s in sizes])
        by = pdf.groupby("group")
        return pdf.assign(leader=by["name"].transform("first"), place=by.cumcount(), members=by["name"].transform("size"))[["name", "leader", "place", "members", "n_rows"]]

    chosen = files.filter(F.col("n_rows") < small).select("name", "part", "n_rows", "lot", "piece")
    return chosen.groupBy("part").applyInPandas(pack, "name string, leader string, place int, members int, n_rows long")


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def _files(spark: SparkSession, folder: str):
    """(file system, names of the data files) of a folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return fs, [f for f in found if f.endswith(".parquet")]


def merge(spark: SparkSession, schema, folder: str, plan: DataFrame) -> str:
    """Write one file for each group of several files, its sources one after the other, to a folder beside; returns that folder."""
    rows = plan.filter("members > 1").select("name", "leader", "place", "n_rows").collect()  # a row for each small file
    beside = folder + "-merged"
    if not rows:
        return beside
    number = {leader: i for i, leader in enumerate(sorted({r["leader"] for r in rows}))}
    places = spark.createDataFrame([(r["name"], number[r["leader"]], r["place"]) for r in rows], "source_file string, file_no int, file_place int")
    source = spark.read.schema(schema).parquet(*[f"{folder}/{r['name']}" for r in rows])
    names = source.columns
    plain = source.select(*[_col(c).alias(f"c{i}") for i, c in enumerate(names)], F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.row_index").alias("source_row"))
    placed = plain.join(F.broadcast(places), "source_file").repartitionById(len(number), F.col("file_no")).sortWithinPartitions("file_no", "file_place", "source_row")
    with settings(spark, STAGING):
        placed.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)]).write.option("maxRecordsPerFile", 0).mode("overwrite").parquet(beside)
    got = spark.read.schema(schema).parquet(beside).count()
    if got != sum(r["n_rows"] for r in rows):
        raise RuntimeError(f"{beside} holds {got} rows, its sources hold {sum(r['n_rows'] for r in rows)}; nothing was deleted")
    return beside


def finish(spark: SparkSession, folder: str, beside: str, plan: DataFrame) -> None:
    """Move merged files into the folder as merged-*, then delete their sources. Running it again does what is left."""
    fs, made = _files(spark, beside)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for name in made:
        if not fs.rename(path(f"{beside}/{name}"), path(f"{folder}/merged-{name}")):
            raise RuntimeError(f"{beside}/{name} could not be moved to {folder}")
    replaced = plan.filter("members > 1")
    here = sum(f.startswith("merged-") for f in _files(spark, folder)[1])
    if here < replaced.select("leader").distinct().count():
        raise RuntimeError(f"{folder} lacks merged files; nothing was deleted")
    for r in replaced.select("name").toLocalIterator():
        fs.delete(path(f"{folder}/{r['name']}"), False)
    fs.delete(path(beside), True)


def compact(spark: SparkSession, schema, folder: str, files: DataFrame, small: int, capacity: int) -> None:
    """Replace the small files of each part of a folder by one file a group; files: name, part, n_rows, lot, piece."""
    plan = stage(packed(files, small, capacity), "compaction-plan")
    finish(spark, folder, merge(spark, schema, folder, plan), plan)


def _key(ids: Column) -> Column:
    return F.crc32(F.coalesce(ids.cast("string"), F.lit("")).cast("binary"))


class Lots:
    """Days, lots and pieces of a table's rows, and the number of the file that each row belongs to."""

    def __init__(self, table: DataFrame, time: str, ids: str):
        self.time, self.ids = time, ids
        day = F.unix_date(F.to_date(_col(time))).cast("long")
        days = stage(table.groupBy(day.alias("day")).agg(F.count("*").alias("day_rows")), "compaction-days")
        found = days.agg(F.coalesce(F.sum("day_rows"), F.lit(0)).alias("n"), F.count("*").alias("days")).first()
        self.rows = found["n"]
        lots = (F.lit(1) + F.floor(F.col("day_rows") / F.lit(self.share(LOT)))).cast("long")
        before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)  # a row for each calendar day
        days = days.withColumn("lots", lots).withColumn("base", F.coalesce(F.sum("lots").over(before), F.lit(0)) * PIECES)
        self.days = F.broadcast(days) if found["days"] <= DAYS else days
        self.files = (days.agg(F.sum("lots")).first()[0] or 0) * PIECES

    def share(self, part: int) -> int:
        return 1 + self.rows // part

    def placed(self, table: DataFrame) -> DataFrame:
        """table (columns c0, c1, ... and what else it has) with day, lot, piece and base; time and ids are looked up by position."""
        h = F.col("h")
        day = F.unix_date(F.to_date(F.col("row_time"))).cast("long")
        keyed = table.withColumn("row_day", day).withColumn("h", _key(F.col("row_id")))
        joined = keyed.join(self.days, F.col("row_day").eqNullSafe(F.col("day")))
        lot = (F.floor(h / 16).cast("long") % F.col("lots")).cast("long")
        piece = F.least(h % 4, F.floor(h / 4).cast("long") % 4).cast("long")
        return joined.withColumn("lot", lot).withColumn("piece", piece)

    def plain(self, table: DataFrame, *more: Column) -> DataFrame:
        """The table's columns by position, with the time and the id once more under names of our own."""
        names = table.columns
        return table.select(*[_col(c).alias(f"c{i}") for i, c in enumerate(names)], _col(self.time).alias("row_time"), _col(self.ids).alias("row_id"), *more)


def start(table: DataFrame, folder: str, lots: Lots) -> None:
    """Write the table's rows as one sorted file for each day, lot and piece that occurs."""
    names = table.columns
    placed = lots.placed(lots.plain(table)).withColumn("number", (F.col("base") + F.col("lot") * PIECES + F.col("piece")).cast("int"))
    # the first partition is always written, so a number that has rows stands first
    first = placed.select("number").first()[0]
    dealt = placed.withColumn("number", F.pmod(F.col("number") - F.lit(first), F.lit(lots.files))).repartitionById(lots.files, F.col("number"))
    with settings(table.sparkSession, STAGING):
        dealt.sortWithinPartitions("number", "row_time", "row_id").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)]).write.option("maxRecordsPerFile", 0).parquet(folder)


class _Digest:
    """What is known of a file while its rows stream by."""

    def __init__(self, path: str):
        self.path, self.sources, self.n, self.low, self.high, self.cents = path, [], 0, None, None, 0
        self.first: tuple = (None, None, None)
        self.last: tuple | None = None
        self.sha = hashlib.sha256()

    def add(self, b: pa.RecordBatch) -> None:
        ids = b.column("row_id")
        text = ",".join(pc.fill_null(pc.cast(ids, pa.string()), "").to_pylist())
        self.sha.update(((b"," if self.n else b"") + text.encode()))
        ends = pc.min_max(ids).as_py()
        if ends["min"] is not None:
            self.low = ends["min"] if self.low is None else min(self.low, ends["min"])
            self.high = ends["max"] if self.high is None else max(self.high, ends["max"])
        with np.errstate(all="ignore"):
            cents = np.floor(100 * np.asarray(pc.fill_null(b.column("amount"), 0.0)) + 0.5)
        self.cents += int(cents[np.abs(cents) < 2.0**62].astype(np.int64).sum(dtype=object)) if len(cents) else 0
        lot, piece = np.asarray(b.column("lot")), np.asarray(b.column("piece"))
        code = lot * PIECES + piece
        for i in [0, *(np.flatnonzero(np.diff(code)) + 1).tolist()]:
            source = (int(lot[i]), int(piece[i]))
            if not self.n and not i:
                self.first = (b.column("day")[0].as_py(), *source)
            if source != self.last:
                self.sources.append("%d-%d" % source)
                self.last = source
        self.n += b.num_rows

    def row(self) -> list:
        return [self.path, *self.first, self.n, self.low, self.high, self.cents, ",".join(self.sources), self.sha.hexdigest()]


FILE = "path string, day long, lot long, piece long, n_rows long, min_click_id long, max_click_id long, cents long, sources string, ids_sha256 string"


def digests(rows: DataFrame) -> DataFrame:
    """A row for each file of rows (path, source_row, row_id, amount, day, lot, piece), read in the file's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = FILE.replace(" string", "").replace(" long", "").split(", ")
        types = [pa.string() if " string" in c else pa.int64() for c in FILE.split(", ")]
        flush = lambda done: pa.RecordBatch.from_arrays([pa.array([d.row()[i] for d in done], t) for i, t in enumerate(types)], names)
        now = None
        for b in batches:
            if not b.num_rows:
                continue
            done = []
            path = b.column("path").dictionary_encode()
            cuts = [0, *(np.flatnonzero(np.diff(np.asarray(path.indices))) + 1).tolist(), b.num_rows]
            for low, high in zip(cuts, cuts[1:]):
                name = path[low].as_py()
                if now is None or now.path != name:
                    done += [now] if now else []
                    now = _Digest(name)
                now.add(b.slice(low, high - low))
            if done:
                yield flush(done)
        if now:
            yield flush([now])

    return rows.repartition("path").sortWithinPartitions("path", "source_row").select("path", "row_id", "amount", "day", "lot", "piece").mapInArrow(run, FILE)


def op11_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = spark.read.parquet(f"{sf_dir}/clicks.parquet")
    folder = stage_path(spark, "compaction")
    lots = Lots(clicks, "arrived_at", "click_id")
    result = FILE + ", columns string, rewritten boolean"
    if not lots.rows:
        return spark.createDataFrame([], result)
    start(clicks, folder, lots)
    name, row = F.col("_metadata.file_name").alias("name"), F.col("_metadata.row_index").alias("source_row")
    written = spark.read.schema(clicks.schema).parquet(folder)
    files = lots.placed(lots.plain(written, name)).groupBy("name").agg(F.min("day").alias("part"), F.min("lot").alias("lot"), F.min("piece").alias("piece"), F.count("*").alias("n_rows"))
    compact(spark, clicks.schema, folder, files, lots.share(SMALL), lots.share(FULL))
    final = spark.read.schema(clicks.schema).parquet(folder)
    rows = lots.placed(lots.plain(final, F.concat(F.lit(folder + "/"), F.col("_metadata.file_name")).alias("path"), row, F.col("value").cast("double").alias("amount")))
    read = spark.read.parquet(folder).columns
    return digests(rows).select("*", F.lit(",".join(read)).alias("columns"), F.element_at(F.split("path", "/"), -1).startswith("merged-").alias("rewritten"))


QUERIES = {"op11_compaction": op11_compaction}
ORACLE: dict[str, str] = {}
