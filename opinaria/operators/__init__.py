"""DataFrame -> DataFrame operators. They take column names, hold no state, and work on batch and streaming input
unless they say otherwise."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import DAYS, city_label, has_id, text_digest, weekday_name


#: Rows and bytes of a dimension that may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def at_least_one(value: int, what: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 1:
        raise ValueError(f"{what} must be a whole number of at least 1, not {value!r}")
    return value


def guard(df: DataFrame, key: str = "user_id") -> DataFrame:
    """Rows whose key is there and not empty."""
    return df.where(has_id(key))


def count_by(df: DataFrame, *keys: str, name: str = "reviews") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def having_at_least(df: DataFrame, n: int, name: str = "reviews") -> DataFrame:
    return df.where(F.col(name) >= at_least_one(n, "the threshold"))


def all_match(df: DataFrame, key: str, predicate: Column, min_rows: int, name: str = "reviews") -> DataFrame:
    """Keys with at least `min_rows` rows, all of which meet the predicate (null doesn't): one aggregate, one shuffle."""
    out = guard(df, key).groupBy(key).agg(F.count(F.lit(1)).alias(name), F.count_if(predicate).alias("_met"))
    return having_at_least(out, min_rows, name).where(F.col(name) == F.col("_met")).select(key, name)


def all_match_by_join(df: DataFrame, key: str, predicate: Column, min_rows: int, name: str = "reviews") -> DataFrame:
    """The same as all_match, as a join of two aggregates (batch only); kept to check the one-pass form."""
    rows = guard(df, key)
    met = count_by(rows.where(predicate), key, name="_met")
    return having_at_least(count_by(rows, key, name=name), min_rows, name).join(met, key).where(F.col(name) == F.col("_met")).select(key, name)


def distinct_pairs(df: DataFrame, key: str = "user_id", text: str = "text", name: str = "hashed_text") -> DataFrame:
    """Distinct (key, digest of text); the digest keeps whole texts out of the shuffle."""
    return guard(df, key).select(key, F.coalesce(text_digest(text), F.lit("")).alias(name)).dropDuplicates()


def distinct_count(df: DataFrame, key: str = "user_id", text: str = "text", name: str = "distinct") -> DataFrame:
    """Distinct texts of a key (batch only)."""
    return guard(df, key).groupBy(key).agg(F.countDistinct(F.coalesce(text_digest(text), F.lit(""))).alias(name))


def single_valued(df: DataFrame, key: str = "user_id", text: str = "text", min_rows: int = 1, name: str = "reviews") -> DataFrame:
    """Keys with at least `min_rows` rows that all have the same text. The least and the greatest digest are equal
    exactly if there is one, which needs one shuffle and a fixed state for each key."""
    digest = F.coalesce(text_digest(text), F.lit(""))
    out = guard(df, key).groupBy(key).agg(F.count(F.lit(1)).alias(name), F.min(digest).alias("_lo"), F.max(digest).alias("_hi"))
    return having_at_least(out, min_rows, name).where("_lo = _hi").select(key, name)


def single_valued_by_join(df: DataFrame, key: str = "user_id", text: str = "text", min_rows: int = 1, name: str = "reviews") -> DataFrame:
    """The same as single_valued, by distinct pairs and a semi join (batch only); kept to check the one-pass form."""
    one = count_by(distinct_pairs(df, key, text), key, name="_n").where("_n = 1")
    return having_at_least(count_by(guard(df, key), key, name=name), min_rows, name).join(one, key, "left_semi")


def weekday_counts(df: DataFrame, day: str = "review_date") -> DataFrame:
    """Rows by the day's name; rows without a date don't count."""
    return count_by(df.where(F.col(day).isNotNull()).select(weekday_name(day).alias("weekday")), "weekday")


def weekday_histogram(counts: DataFrame) -> DataFrame:
    """All seven days in order, 0 where nothing was counted (batch only)."""
    days = counts.sparkSession.createDataFrame(list(enumerate(DAYS)), "position int, weekday string")
    return days.join(F.broadcast(counts), "weekday", "left").select("position", "weekday", F.coalesce("reviews", F.lit(0)).cast("long").alias("reviews"))


def city_labels(business: DataFrame) -> DataFrame:
    """business_id and its `City (State)`, one row for each id: repeated ids take the least label. A null id is no business."""
    return business.where(F.col("business_id").isNotNull()).select("business_id", city_label().alias("city")).groupBy("business_id").agg(F.min("city").alias("city"))


def funny_reviews(reviews: DataFrame) -> DataFrame:
    return reviews.where("funny > 0").select("business_id")


def funny_by_business(reviews: DataFrame) -> DataFrame:
    """Reviews with a funny vote, by business: reviews count, votes don't add up."""
    return count_by(funny_reviews(reviews), "business_id", name="funny")


def dimension(business: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """city_labels(business), marked for broadcast if the businesses are found to be `rows` rows and `size` bytes of ids and
    labels at most, else to be joined by a shuffle: Spark's own guess rests on the size of files, which says little about
    compressed ones and nothing about what a plan makes of them. At most rows + 1 businesses are read to find out."""
    head = business.select("business_id", city_label().alias("city")).limit(rows + 1)
    found = head.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length(F.concat(F.col("business_id").cast("string"), "city"))), F.lit(0)).alias("size")).first()
    labels = city_labels(business)
    return F.broadcast(labels) if found.rows <= rows and found.size <= size else labels.hint("merge")


def funny_by_city(reviews: DataFrame, business: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Aggregates by business before the join, so that the join sees a row for each business. On a stream, where
    aggregates can't be chained, the static businesses join first, as they are when the query starts; streaming.Flows joins
    last and reads the businesses anew for each batch."""
    labels = dimension(business, rows, size)
    if reviews.isStreaming:
        return count_by(funny_reviews(reviews).join(labels, "business_id"), "city", name="funny")
    return funny_of(funny_by_business(reviews), labels)


def funny_of(counts: DataFrame, labels: DataFrame) -> DataFrame:
    """(city, funny) of counts by business."""
    return counts.join(labels, "business_id").groupBy("city").agg(F.sum("funny").alias("funny"))


def top_k(df: DataFrame, k: int, by: str, tie: str) -> DataFrame:
    """The k largest; ties go by ascending label."""
    return df.orderBy(F.desc(by), F.asc(tie)).limit(at_least_one(k, "k"))


def reviewed(business: DataFrame, reviews: DataFrame) -> DataFrame:
    """Businesses that some review names. Reviews are reduced to distinct businesses before the join (batch only)."""
    return business.join(reviews.select("business_id").distinct(), "business_id", "left_semi")


def sample_reviews(reviews: DataFrame, n: int, *extra: DataFrame) -> DataFrame:
    """The first n reviews and all rows of `extra` (a sampling operator)."""
    out = reviews.limit(at_least_one(n, "the sample size"))
    for df in extra:
        out = out.unionByName(df)
    return out
