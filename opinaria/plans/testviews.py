"""`reviews` and `business` over the order tables, for checks against SQL on the same tables."""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.scratch import scratch_dir
from ..sources.sizes import settings, shuffles

_REVIEW = [
    "concat(cast(l_orderkey as string), '-', cast(l_linenumber as string)) review_id",
    "l_orderkey", "o_custkey user_id", "l_suppkey business_id",
    "cast(ceil(l_quantity / 10) as int) stars",
    "greatest(cast(round(l_discount * 100) as int) - 5, 0) funny",
    "o_orderpriority as text", "cast(l_shipdate as date) review_date",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """A row for each order line; with stream, the lines are a streaming source and the orders stay static."""
    lines = table(spark, sf_dir, "lineitem")
    if stream:
        lines = spark.readStream.schema(lines.schema).parquet(f"{sf_dir}/lineitem.parquet*")
    return lines.join(table(spark, sf_dir, "orders"), F.expr("l_orderkey = o_orderkey")).selectExpr(*_REVIEW).drop("l_orderkey")


def reviews_by_order(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """The same rows with the order as the user, so that some users give five stars only."""
    return reviews(spark, sf_dir, stream).withColumn("user_id", F.split_part("review_id", F.lit("-"), F.lit(1)).cast("long"))


def business(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.expr("s_nationkey = n_nationkey")).join(table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
    return out.selectExpr("s_suppkey business_id", "n_name city", "r_name state")


def activity(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """Events by user and day, so that some users always post the same text."""
    events = table(spark, sf_dir, "events")
    if stream:
        events = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")
    return events.selectExpr(
        "cast(event_id as string) review_id", "concat(cast(user_id as string), '|', cast(cast(ts as date) as string)) user_id",
        "event_type as text", "cast(ts as date) review_date",
    )


#: Lines that a file holds: compressed, a file is read by one task.
LINES = 250_000

#: Folders of lines that this application has written.
_folders: dict[tuple[str, str, str], str] = {}


def rows_of(spark: SparkSession, sf_dir: str) -> int:
    """Reviews at most; from the metadata of the files."""
    return table(spark, sf_dir, "lineitem").count()


def _written(spark: SparkSession, sf_dir: str, name: str, lines: Callable[[], DataFrame], bounded: bool = True) -> str:
    """A folder of compressed text files, of LINES lines each at most if `bounded`, with what `lines` gives in column `value`;
    written once for each session and input."""
    key = spark.sparkContext.applicationId, sf_dir, name
    if key not in _folders:
        path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        with settings(spark, shuffles(spark, rows_of(spark, sf_dir))):
            lines().select("value").write.option("maxRecordsPerFile", LINES if bounded else 0).text(path, compression="lz4")
        _folders[key] = path
    return _folders[key]


def _json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))


def _as_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `reviews_by_order` view in the shape of real reviews: ids as text, numbers plain or quoted."""
    return reviews_by_order(spark, sf_dir).selectExpr(
        "review_id", "cast(user_id as string) user_id", "cast(business_id as string) business_id", "cast(stars as double) stars",
        "0 useful", "cast(funny as string) funny", "0 cool", "text", "concat(cast(review_date as string), ' 10:00:00') date")


def review_lines(spark: SparkSession, sf_dir: str) -> str:
    return _written(spark, sf_dir, "review-lines", lambda: _json(_as_given(spark, sf_dir)))


def dirty_lines(spark: SparkSession, sf_dir: str) -> str:
    """The same lines, those with one funny vote cut off in the middle."""
    def lines() -> DataFrame:
        rows = _as_given(spark, sf_dir).select("funny", F.to_json(F.struct("*")).alias("value"))
        return rows.select(F.when(F.col("funny") == "1", F.expr("left(value, 40)")).otherwise(F.col("value")).alias("value"))

    return _written(spark, sf_dir, "dirty-lines", lines)


def trigger_files(spark: SparkSession, sf_dir: str, least: int, most: int) -> str:
    """Files of a batch of a stream that takes the lines in some four batches; in more, if those were above `most` files."""
    return str(max(least, min(most, rows_of(spark, sf_dir) // (4 * LINES))))


def ordered_lines(spark: SparkSession, sf_dir: str, files: int = 7) -> str:
    """The same lines in `files` parts, which put together by name go by order, line number and funny votes. A part is one file or,
    of many lines, `part_files` files of about LINES lines, which a task can sort."""
    def lines() -> DataFrame:
        given = _as_given(spark, sf_dir)
        rows = given.select("*", F.split("review_id", "-").cast("array<long>").alias("at"), F.col("funny").cast("long").alias("votes"))
        rows = rows.repartitionByRange(files * part_files(spark, sf_dir, files), "at", "votes").sortWithinPartitions("at", "votes")
        return rows.select(F.to_json(F.struct(*given.columns)).alias("value"))

    return _written(spark, sf_dir, f"ordered-lines-{files}", lines, False)


def part_files(spark: SparkSession, sf_dir: str, files: int) -> int:
    """Files of each part of `ordered_lines`."""
    return max(1, -(-rows_of(spark, sf_dir) // (files * LINES)))


def ordered_part(spark: SparkSession, sf_dir: str, files: int, *parts: int) -> str:
    """Some of the parts of `ordered_lines`, as a pattern of their files."""
    each = part_files(spark, sf_dir, files)
    return f"{ordered_lines(spark, sf_dir, files)}/part-{{{','.join(f'{i:05d}' for p in parts for i in range(p * each, (p + 1) * each))}}}*"


def dirty_business_lines(spark: SparkSession, sf_dir: str) -> str:
    """Business lines, some cut off, some with a second object behind, some without an id, some with maps that aren't."""
    def lines() -> DataFrame:
        rows = business(spark, sf_dir).selectExpr("business_id n", "if(business_id % 7 = 0, if(business_id % 2 = 0, null, ''), cast(business_id as string)) business_id", "city", "state", "if(business_id % 3 = 0, 'none', null) attributes", "map('Monday', '9-5') hours")
        line = F.to_json(F.struct("business_id", "city", "state", "attributes", "hours"))
        return rows.select(F.when(F.expr("n % 5 = 0"), F.left(line, F.lit(20))).when(F.expr("n % 11 = 0"), F.concat(line, F.lit(' {"x": 1}'))).otherwise(line).alias("value"))

    return _written(spark, sf_dir, "dirty-businesses", lines)


def business_lines(spark: SparkSession, sf_dir: str) -> str:
    return _written(spark, sf_dir, "business-lines", lambda: _json(business(spark, sf_dir).selectExpr("cast(business_id as string) business_id", "city", "state", "map('Monday', '9-5') hours")))


#: The same views for DuckDB.
CTE = """with reviews as (
  select concat(cast(l_orderkey as varchar), '-', cast(l_linenumber as varchar)) review_id, o_custkey user_id, l_suppkey business_id,
         cast(ceil(l_quantity / 10) as int) stars, greatest(cast(round(l_discount * 100) as int) - 5, 0) funny,
         o_orderpriority as text, cast(l_shipdate as date) as date
  from lineitem join orders on l_orderkey = o_orderkey),
business as (
  select s_suppkey business_id, n_name city, r_name state
  from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
reviews_by_order as (
  select review_id, cast(split_part(review_id, '-', 1) as bigint) user_id, business_id, stars, funny, text, date from reviews),
activity as (
  select cast(event_id as varchar) review_id, concat(cast(user_id as varchar), '|', cast(cast(ts as date) as varchar)) user_id,
         event_type as text, cast(ts as date) as date
  from events)
"""
