"""Shared helpers of the text operators: staging tables, word arrays, buckets."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text a Python worker works on at once, bytes of a batch sent to it while a table is staged.
SLICE_BYTES, BATCH_BYTES = 4 << 20, 4 << 20
#: Bytes of a group after which freed memory goes.
LARGE = 1 << 20
#: Bytes that what a worker remembers (words, paths, steps) may take, over all its caches of one operator.
CACHE_BYTES = 64 << 20
#: Bytes of text that one bucket of a hash-dealt step answers for.
BUCKET_BYTES = 128 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a local session without one gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="trailmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for the length of a block; what was set before comes back."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: While a table is staged: Spark deletes the query's shuffle files when it ends, and Python gets batches of bounded bytes.
BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"
STAGING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", BATCHES: str(BATCH_BYTES)}


def bound_batches(spark: SparkSession) -> None:
    """Python gets batches of bounded bytes from here on, for a table that the caller writes; a smaller bound of the session's stays.

    Spark reads the setting when the caller's query is planned, so it can't end with the operator that asks for it.
    """
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCHES)) > BATCH_BYTES:
        spark.conf.set(BATCHES, str(BATCH_BYTES))


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/trailmill/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    with settings(spark, STAGING):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stage(df: DataFrame) -> None:
    """Delete the files of a staged table that no later step reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    """Tasks of a step that is dealt by key or range: as many as the session's shuffles have."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def buckets_for(docs: DataFrame, text: str = "text", most: int = BUCKET_BYTES) -> int:
    """Buckets of a step that loads a bucket whole: by counted bytes of text, as many as shuffles have at least."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(partitions(docs.sparkSession), -(-int(total) // most))


def room(entry_bytes: int, share: float = 1.0) -> int:
    """Entries of about so many bytes that a cache with this share of CACHE_BYTES may hold."""
    return max(1, int(CACHE_BYTES * share / entry_bytes))


def crc_mod(column: str, modulus: int):
    """crc32(id as text) modulo a number; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


class WordHashes(dict):
    """word bytes -> 64-bit hash, remembered for as long as a task keeps the object."""

    #: A word, its number and their place take about 170 bytes.
    MOST = room(170)

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def words_of(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of the text as UTF-8 with A-Z lower-cased (bytes.split and bytes.lower do just that)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * _MIX2
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; fewer words make one shingle of the whole sequence."""
    if not len(hashes):
        return hashes
    with np.errstate(over="ignore"):
        if len(hashes) < n:
            h = np.uint64(len(hashes) + 1)
            for w in hashes:
                h = (h * _MIX) ^ w
                h = mix(np.array([h], np.uint64))[0]
            return np.array([h], np.uint64)
        m = len(hashes) - n + 1
        h = hashes[:m].copy()
        for j in range(1, n):
            h = mix(h * _MIX + hashes[j : j + m])
    return np.unique(h)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about limit bytes of the column (one row at least)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(size) + 64
    if start < len(sizes):
        yield batch.slice(start)


#: What a Python worker keeps from task to task, of one operator at a time.
REMEMBERED: dict = {}
try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # another C library
    _trim = None


def forget() -> None:
    """Drop what the worker keeps. (A closure that named the table itself would be sent with a copy of it.)"""
    REMEMBERED.clear()


def release() -> None:
    """Give the memory that was freed back to the system: a worker lives on beside the JVM, and counts with it."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run(batches) for mapInArrow, whose worker holds no freed memory after it, nor what another operator keeps, unless keeps."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            forget()
        try:
            yield from run(batches)
        finally:
            release()

    return task


def lean_group(work: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """work(table) or work(left, right) for applyInArrow; after a group of LARGE bytes freed memory goes."""

    @functools.wraps(work)
    def task(*tables: pa.Table) -> pa.Table:
        try:
            return work(*tables)
        finally:
            if sum(t.nbytes for t in tables) >= LARGE:
                release()

    if work.__code__.co_argcount == 2:
        return lambda left, right: task(left, right)
    return lambda table: task(table)


def crc32_of(b: bytes) -> int:
    return zlib.crc32(b) & 0xFFFFFFFF


def time_major(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order for stepping through many sequences at once.

    Returns (by_length: sequences from long to short, order: flat positions
    step by step, starts: where each step's run begins in that order, alive:
    sequences at each step). Flat positions count through the sequences in
    their given order.
    """
    by_length = np.argsort(-lengths, kind="stable")
    longest = int(lengths[by_length[0]]) if len(lengths) else 0
    sorted_lengths = lengths[by_length]
    offsets = np.concatenate([[0], np.cumsum(lengths)])[:-1][by_length]
    alive = len(lengths) - np.searchsorted(sorted_lengths[::-1], np.arange(1, longest + 1), side="left")
    starts = np.concatenate([[0], np.cumsum(alive)]).astype(np.int64)
    total = int(starts[-1])
    step = np.repeat(np.arange(longest), alive)
    order = offsets[np.arange(total) - starts[:-1][step]] + step
    return by_length, order, starts, alive


def pack(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(bucket, bytes of each column's rows in it), by bucket."""
    order = np.argsort(bucket, kind="stable")
    found, starts = np.unique(bucket[order], return_index=True)
    cuts = [*starts.tolist(), len(order)]
    sorted_columns = [c[order] for c in columns]
    for b, low, high in zip(found.tolist(), cuts, cuts[1:]):
        yield b, *[c[low:high].tobytes() for c in sorted_columns]


def joined(column: pa.ChunkedArray, dtype) -> np.ndarray:
    """The numbers packed in the column's rows, one row after the other."""
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), dtype)
