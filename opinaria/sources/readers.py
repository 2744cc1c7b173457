"""Review and business readers, batch and streaming, behind one parser and one normalizer for each feed.

A line of a feed is either a record or a reject, the same in batch and on streams. Blank lines are neither. A line is rejected
if it isn't exactly one JSON object (cut off, followed by something else, an array, a plain value) or if a field that the feed
needs is null or empty. Values that don't parse as their field's type become null, absent fields too; of a field that stands
twice the last counts."""
from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .schemas import BUSINESS, BUSINESS_RAW, REVIEW, REVIEW_RAW

#: JSON as its standard has it: no single quotes, no NaN.
STRICT = {"mode": "PERMISSIVE", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
#: Why a line is rejected.
MALFORMED, NO_ID = "not one JSON object", "no "


class Feed(NamedTuple):
    """What a line holds: its fields as text, how they become typed columns, and the fields without which it is rejected."""

    raw: T.StructType
    normalize: Callable[..., DataFrame]
    needs: tuple[str, ...] = ()


def normalize_reviews(df: DataFrame, *more: str) -> DataFrame:
    """Casts to the REVIEW schema. Absent columns and values that don't parse become null; `date` keeps its text
    and its first ten characters become `review_date`. Columns named in `more` stay as they are."""
    def col(name: str, kind: T.DataType):
        return F.col(name).try_cast(kind) if name in df.columns else F.lit(None).cast(kind)

    cols = [col(f.name, f.dataType).alias(f.name) for f in REVIEW if f.name != "review_date"]
    day = F.expr("try_to_date(substring(cast(`date` as string), 1, 10), 'yyyy-MM-dd')") if "date" in df.columns else F.lit(None).cast("date")
    return df.select(*cols, day.alias("review_date"), *more)


def normalize_businesses(df: DataFrame, *more: str) -> DataFrame:
    """Casts to the BUSINESS schema; absent columns become null. Maps may be given as JSON text. Columns named in `more` stay as
    they are."""
    given = {f.name: f.dataType for f in df.schema}

    def col(name: str, kind: T.DataType) -> Column:
        if name not in given:
            return F.lit(None).cast(kind)
        if isinstance(kind, T.MapType) and isinstance(given[name], T.StringType):
            return F.from_json(F.col(name), kind, STRICT)
        return F.col(name).try_cast(kind)

    return df.select(*(col(f.name, f.dataType).alias(f.name) for f in BUSINESS), *more)


REVIEWS = Feed(REVIEW_RAW, normalize_reviews)
BUSINESSES = Feed(BUSINESS_RAW, normalize_businesses, ("business_id",))


def parse(lines: DataFrame, feed: Feed, value: str = "value") -> DataFrame:
    """(line, reason, record): every line of any batch or streaming source that isn't blank, text or bytes. `reason` is null for
    a record. One parse serves both outputs, `records` and `rejects`."""
    text = F.col(value).cast("string")
    rows = lines.where(text.rlike(r"[^ \t\r\n]")).select(text.alias("line"))
    # in brackets, what follows an object makes the whole malformed, but for a bracket; such lines are tried in braces too
    several = F.from_json(F.concat(F.lit("["), "line", F.lit("]")), T.ArrayType(feed.raw), STRICT)
    inside = F.from_json(F.concat(F.lit('{"r":'), "line", F.lit("}")), T.StructType([T.StructField("r", T.StringType())]), STRICT)
    one = (F.size("several") == 1) & ((F.instr("line", "]") == 0) | inside["r"].isNotNull())
    # a filter isn't pushed through the explode of this one row, so no line is parsed again for `reason` or a field
    rows = rows.select("line", F.explode_outer(F.array(several)).alias("several"))
    rows = rows.select("line", F.when(F.coalesce(one, F.lit(False)), F.get("several", F.lit(0))).alias("record"))
    reason = F.when(F.col("record").isNull(), MALFORMED)
    for name in feed.needs:
        reason = reason.when(F.coalesce(F.col(f"record.{name}"), F.lit("")) == "", NO_ID + name)
    return rows.select("line", reason.alias("reason"), "record")


def records(parsed: DataFrame, feed: Feed) -> DataFrame:
    return feed.normalize(parsed.where("reason is null").select("record.*"))


def tagged(parsed: DataFrame, feed: Feed) -> DataFrame:
    """Records and rejects in one table, for what asks for both in one pass: the record's columns (null for a reject), `line` (null
    for a record) and `reason` (null for a record)."""
    tags = [F.when(F.col("reason").isNotNull(), F.col("line")).alias("line"), F.col("reason")]
    return feed.normalize(parsed.select("record.*", *tags), "line", "reason")


def rejects(parsed: DataFrame) -> DataFrame:
    return parsed.where("reason is not null").select("line", "reason")


def read_with_rejects(spark: SparkSession, path: str, feed: Feed) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of NDJSON files."""
    parsed = parse(spark.read.text(path), feed)
    return records(parsed, feed), rejects(parsed)


def read_tagged(spark: SparkSession, path: str, feed: Feed) -> DataFrame:
    """`tagged` of NDJSON files: records and rejects from one pass."""
    return tagged(parse(spark.read.text(path), feed), feed)


def stream_parsed(spark: SparkSession, path: str, feed: Feed, **options: str) -> DataFrame:
    """`parse` over the lines of files as they arrive under `path`."""
    return parse(spark.readStream.format("text").options(**options).load(path), feed)


def _read(spark: SparkSession, path: str, fmt: str, feed: Feed) -> DataFrame:
    return read_with_rejects(spark, path, feed)[0] if fmt == "json" else feed.normalize(spark.read.format(fmt).load(path))


def read_reviews(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Reviews from NDJSON or a columnar format."""
    return _read(spark, path, fmt, REVIEWS)


def read_businesses(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Businesses from NDJSON or a columnar format."""
    return _read(spark, path, fmt, BUSINESSES)


def messages(df: DataFrame, value: str = "value") -> DataFrame:
    """Reviews from messages, each one JSON object in column `value` (text or bytes), of any batch or streaming source.
    Null, blank and malformed messages give no review."""
    return records(parse(df, REVIEWS, value), REVIEWS)


def read_reviews_with_rejects(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(reviews, rejected lines) of an NDJSON file. A malformed line is only in the second."""
    return read_with_rejects(spark, path, REVIEWS)


def read_businesses_with_rejects(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(businesses, rejected lines) of an NDJSON file; lines without a business_id are rejected, too."""
    return read_with_rejects(spark, path, BUSINESSES)


def stream_reviews(spark: SparkSession, path: str, fmt: str = "json", schema: T.StructType | None = None, **options: str) -> DataFrame:
    """A streaming scan of files as they arrive under `path`, with the same reviews as a batch scan of them."""
    if fmt == "json" and schema is None:
        return records(stream_parsed(spark, path, REVIEWS, **options), REVIEWS)
    return normalize_reviews(spark.readStream.format(fmt).schema(schema or REVIEW_RAW).options(**options).load(path))


def union_streams(first: DataFrame, *more: DataFrame) -> DataFrame:
    """One input made of several, e.g. the files there are and a live feed."""
    for df in more:
        first = first.unionByName(df)
    return first
