"""The first lines of a folder, in the order of its files.

`limit` takes any rows; these are those that stand first. Files go by path. They are counted in groups that double until the
lines asked for are reached, so a short head of a large folder reads a few files. Only the last file is cut: there a line's
place is what its blocks before hold and its place in its block, both from the file's metadata, whatever tasks read them."""
from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..operators import at_least_one


def _files(spark: SparkSession, path: str) -> list[str]:
    return sorted(map(unquote, spark.read.text(path).inputFiles()))


def _counts(spark: SparkSession, files: list[str]) -> dict[str, int]:
    """Lines of each file of a group."""
    lines = spark.read.text(files).groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("lines"))
    return {unquote(r.file): r.lines for r in lines.collect()}


def _head(spark: SparkSession, file: str, n: int) -> DataFrame:
    """The first n lines of one file."""
    lines = spark.read.text(file).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    blocks = lines.groupBy("block").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("lines"))
    before = F.coalesce(F.sum("lines").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row for each block of one file
    blocks = blocks.select("block", "first", before.alias("before")).where(F.col("before") < n)
    return lines.join(F.broadcast(blocks), "block").where(F.col("before") + F.col("place") - F.col("first") < n).select("value")


def first_lines(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(value): the first n lines under `path`, blank ones too; all of them if there are fewer."""
    files, left, whole, step = _files(spark, path), at_least_one(n, "the number of lines"), [], 1
    while files and left:
        group, files = files[:step], files[step:]
        found = _counts(spark, group)
        for file in group:
            lines = found.get(file, 0)
            if lines > left:
                head = _head(spark, file, left)
                return spark.read.text(whole).select("value").unionByName(head) if whole else head
            if lines:
                whole.append(file)
                left -= lines
            if not left:
                break
        step *= 2
    return spark.read.text(whole).select("value") if whole else spark.createDataFrame([], "value string")
