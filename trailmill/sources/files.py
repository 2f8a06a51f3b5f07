"""Readers and writers of row files."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, tolerant: bool = False) -> DataFrame:
    """SRC1, SRC13: a missing file is empty; bad lines fail, or are skipped if tolerant."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def read_raw_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """SRC3: raw line, parsed struct and whether the line is blank or no record."""
    lines = spark.read.text(path).withColumnRenamed("value", "raw")
    return lines.withColumn("record", F.from_json("raw", schema)).withColumn("bad", (F.trim("raw") == "") | F.col("record").isNull())


def task_id(columns: list[str]) -> Column:
    """SRC6: the id from the first of its places that has one."""
    places = [c for c in ("task_id", "extra_info.task_id", "normalized_trajectory.task_id") if c.split(".")[0] in columns]
    return F.coalesce(*[F.col(c) for c in places])


def read_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """SRC5: rows of one large top-level array."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def parse_log(lines: DataFrame, line: str, position: str, fields: list[str]) -> DataFrame:
    """SRC10, SRC14: `key:value` fields by step, without colour codes; the last line of a step wins."""
    clean = F.regexp_replace(F.col(line), "\x1b\\[[0-9;]*m", "")
    value = lambda name: F.expr(f"try_cast(nullif(regexp_extract(_l, '(?:^|[ ,])' || '{name}' || ':(?:np[.]float64[(])?([-+0-9.eE]+)', 1), '') AS double)")
    rows = lines.withColumn("_l", clean).select(position, value("step").cast("long").alias("step"), *[value(f).alias(f) for f in fields]).filter("step IS NOT NULL")
    return rows.groupBy("step").agg(F.max_by(F.struct(*fields), position).alias("r")).select("step", "r.*")


def content_digest(df: DataFrame) -> str:
    """SNK3, SNK12: sha256 of a table's schema and of its rows, whatever their order.

    A row is hashed as the JSON of a struct that keeps nulls, so values cannot move between columns. Row hashes add
    up as four numbers of 60 bits, each in a sum and an exclusive or, so partitions are combined by partial sums.
    """
    columns = sorted(df.columns)
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"}), 256)
    words = [F.conv(F.substring(row, 1 + 16 * i, 15), 16, 10).cast("long") for i in range(4)]
    total = df.select(*[w.alias(f"w{i}") for i, w in enumerate(words)]).agg(F.count("*"), *[f for i in range(4) for f in (F.sum(F.col(f"w{i}").cast("decimal(20,0)")), F.bit_xor(f"w{i}"))]).first()
    schema = [(c, df.schema[c].dataType.simpleString()) for c in columns]
    return hashlib.sha256(json.dumps([schema, [str(x) for x in total]]).encode()).hexdigest()


def freeze(df: DataFrame, path: str) -> str:
    """SNK2, SNK3, SNK4: write once; the same rows again are 'unchanged', others are refused."""
    spark = df.sparkSession
    if exists(spark, path):
        if content_digest(spark.read.parquet(path)) == content_digest(df):
            return "unchanged"
        raise ValueError(f"{path} holds other rows")
    df.write.mode("errorifexists").parquet(path)
    return "written"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """SNK9: name, bytes and sha256 of every file below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    below = F.regexp_replace("path", F.lit("^.*?" + re.escape(path.rstrip("/").split(":")[-1]) + "/"), F.lit(""))
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), below.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def changed(before: DataFrame, now: DataFrame) -> DataFrame:
    """SNK9: path and problem (missing, unexpected, differs) of files that two manifests do not agree on."""
    a, b = before.select("path", F.col("sha256").alias("was")), now.select("path", F.col("sha256").alias("is"))
    problem = F.when(F.col("is").isNull(), "missing").when(F.col("was").isNull(), "unexpected").when(F.col("was") != F.col("is"), "differs")
    return a.join(b, "path", "full_outer").select("path", problem.alias("problem")).filter("problem IS NOT NULL")


def append_log(df: DataFrame, path: str) -> None:
    """SNK1: add rows; a job's rows appear together."""
    df.write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """SNK6."""
    df.write.mode("errorifexists").option("header", True).csv(path)


def pending(expected: DataFrame, done: DataFrame, key: list[str], valid: Column) -> DataFrame:
    """STM7, JN19, SRC12: expected keys without a valid attempt so far."""
    return expected.join(done.filter(valid).select(*key).distinct(), key, "left_anti")


#: Bytes of input files whose rows one task of a step dealt by key answers for.
TASK_BYTES = 4 << 20


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that df reads."""
    context = df.sparkSession.sparkContext
    paths = [context._jvm.org.apache.hadoop.fs.Path(f) for f in df.inputFiles()]
    return sum(p.getFileSystem(context._jsc.hadoopConfiguration()).getFileStatus(p).getLen() for p in paths)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to as many tasks as its input files ask for, so that a task's rows don't grow with the input.

    Spark merges the partitions of a plain shuffle down to one for each core, whatever the input; a stated number it
    leaves as it is. What fits into one task is left to Spark.
    """
    n = -(-input_bytes(df) // TASK_BYTES)
    return df.repartition(max(n, df.sparkSession.sparkContext.defaultParallelism), *keys) if n > 1 else df.repartition(*keys)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores when its files make fewer partitions than that; tables of many files pass unchanged."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)
