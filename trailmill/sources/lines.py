"""Strict scans of line files: exact line numbers and raw bytes over splits, and errors that name their line.

Spark's own text reader cuts files by byte range and reads any store; a reader of our own in Python would see
local paths only. The lines of every split are counted first; a line's number is its place in its split after the lines of
the splits before it. Counts are a row for each split. Lines end at a newline alone, so a carriage return stays in the raw bytes.

Edge cases: an empty file has no lines; a missing path is empty for read_lenient() and an error for the strict
readers; a compressed file is one split, and its last line's newline cannot be told, so it is not missed.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import exists

# What may be wrong with a line.
BLANK, NO_NEWLINE, NOT_JSON, NOT_OBJECT = "blank", "no_final_newline", "not_json", "not_object"
_SPACE = r"^[ \t\n\r\x0b\f]*$"


class LineFault(ValueError):
    """A line of a file is not what a strict reader takes."""

    def __init__(self, path: str, number: int, problem: str):
        super().__init__(f"{path}:{number}: {problem}")
        self.path, self.number, self.problem = path, number, problem


@F.pandas_udf(T.StringType())
def _json_problem(raw: pd.Series) -> pd.Series:
    """not_json or not_object by the rules of the json module; Spark's parsers take what follows a value."""

    def problem(b: bytes | None) -> str | None:
        if b is None:
            return None
        try:
            return None if isinstance(json.loads(b), dict) else NOT_OBJECT
        except (ValueError, RecursionError):
            return NOT_JSON

    return raw.map(problem)


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """path, number (from 1), raw (bytes, with the newline if there is one) and value (text) of every line."""
    place = F.monotonically_increasing_id()
    scan = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), "value", place.alias("place")
    )
    bytes_ = F.sum(F.octet_length("value") + 1)
    splits = scan.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("place").alias("first"), bytes_.alias("bytes"), F.max("size").alias("size"))
    by = Window.partitionBy("path").orderBy("block")
    before = F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = Window.partitionBy("path")
    # counting a newline for each line, a file without the last one seems a byte too long
    starts = splits.select("path", "block", "first", before.alias("before"), F.sum("n").over(whole).alias("lines"), (F.sum("bytes").over(whole) == F.col("size") + 1).alias("open"))
    lines = scan.select("path", "block", "value", "place").join(starts, ["path", "block"])
    number = F.col("before") + F.col("place") - F.col("first") + 1
    ended = ~(F.col("open") & (number == F.col("lines")))
    raw = F.concat(F.col("value").cast("binary"), F.when(ended, F.lit(b"\n")).otherwise(F.lit(b"")))
    return lines.select("path", number.alias("number"), raw.alias("raw"), "value", ended.alias("ended"))


def problem(value: Column, ended: Column) -> Column:
    """SRC3: the first thing wrong with a line, in the order blank, no_final_newline, not_json, not_object; null if nothing is."""
    blank = value.rlike(_SPACE)
    return F.when(blank, BLANK).when(~ended, NO_NEWLINE).otherwise(_json_problem(F.when(~blank, value.cast("binary"))))


def read_strict(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """SRC3: path, number, raw and record of every line; the first bad line of the first bad file stops the scan before any row is given.

    The check reads the lines once more than the rows do. Nothing but the one fault comes to the driver.
    """
    rows = numbered(spark, path)
    wrong = rows.withColumn("problem", problem(F.col("value"), F.col("ended"))).filter("problem IS NOT NULL")
    fault = wrong.agg(F.min(F.struct("path", "number", "problem")).alias("f")).first()["f"]
    if fault:
        raise LineFault(fault["path"], fault["number"], fault["problem"])
    return rows.select("path", "number", "raw", F.from_json("value", schema).alias("record"))


def examined(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """SRC3 as a report: path, number, raw, record (null for a bad line) and problem of every line."""
    rows = numbered(spark, path).withColumn("problem", problem(F.col("value"), F.col("ended")))
    return rows.select("path", "number", "raw", F.when(F.col("problem").isNull(), F.from_json("value", schema)).alias("record"), "problem")


def read_lenient(spark: SparkSession, path: str, schema: T.StructType, skip: bool = False) -> DataFrame:
    """SRC1, SRC13: path, number and record of every line that is not blank; a missing path is empty.

    A line that is no JSON object stops the scan and is named; with skip it is left out.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], T.StructType([T.StructField("path", T.StringType()), T.StructField("number", T.LongType()), T.StructField("record", schema)]))
    rows = numbered(spark, path).filter(~F.col("value").rlike(_SPACE)).withColumn("problem", _json_problem(F.col("value").cast("binary")))
    if not skip:
        fault = rows.filter("problem IS NOT NULL").agg(F.min(F.struct("path", "number", "problem")).alias("f")).first()["f"]
        if fault:
            raise LineFault(fault["path"], fault["number"], fault["problem"])
    return rows.filter("problem IS NULL").select("path", "number", F.from_json("value", schema).alias("record"))


def unique_by(rows: DataFrame, key: str) -> DataFrame:
    """SRC2, SRC4: rows (path, number, record), refused if a record has no key or two have one; the fault names the later line."""
    keyed = rows.withColumn("_key", F.col(f"record.{key}").cast("string"))
    missing = keyed.filter("_key IS NULL").agg(F.min(F.struct("path", "number")).alias("f")).first()["f"]
    if missing:
        raise LineFault(missing["path"], missing["number"], f"no {key}")
    place = F.struct("path", "number")
    several = keyed.groupBy("_key").agg(F.count("*").alias("n"), F.max(place).alias("f")).filter("n > 1").agg(F.min("f").alias("f")).first()["f"]
    if several:
        raise LineFault(several["path"], several["number"], f"{key} was there before")
    return keyed.drop("_key")
