"""A stored profile of all reviews so far, into which new ones are merged without reading the old again.

What the five flows ask of reviews adds up: counts are sums, and a user has one text exactly if the least digest is the greatest.
So the shares of any deliveries, files or batches of a live feed, may be merged in any order, from several writers, and the
five results are those of one scan over everything. Each writer numbers its deliveries, and a number is taken in once."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .. import operators as O
from ..sources.keyed import KeyedTable
from ..sources.sizes import READS, settings, shuffles
from ..streaming.flows import flow_counts
from . import BOTS_MIN, CITIES, USERS_MIN

_L, _S = T.LongType(), T.StringType()


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(*f) for f in fields])


class Ledger:
    """Three tables under `path`: users, weekdays, and funny votes by business."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.users = KeyedTable(spark, f"{path}/users", _schema(("user_id", _S), ("reviews", _L), ("five_star", _L), ("min_text", _S), ("max_text", _S)), ["user_id"], buckets, {"reviews": "sum", "five_star": "sum", "min_text": "min", "max_text": "max"})
        self.weekdays = KeyedTable(spark, f"{path}/weekdays", _schema(("weekday", _S), ("reviews", _L)), ["weekday"], 1, {"reviews": "sum"})
        self.businesses = KeyedTable(spark, f"{path}/businesses", _schema(("business_id", _S), ("funny", _L)), ["business_id"], buckets, {"funny": "sum"})

    def absorb(self, reviews: DataFrame, number: int, writer: str = "files", rows: int = 0) -> None:
        """Takes in a delivery: the writer's numbers must rise, and one that was taken in before changes nothing and isn't read.
        The reviews are read once, and their shares of all three tables kept meanwhile, not they themselves. `rows` says how
        many there are, if that is more than the session's shuffle partitions are meant for."""
        if number <= self.last(writer):
            return
        with settings(reviews.sparkSession, READS | shuffles(reviews.sparkSession, rows)):
            shares = flow_counts(reviews).persist()
            of = lambda kind, key, *more: shares.where(F.col("kind") == kind).select(F.col("key").alias(key), *more)
            try:
                self.users.apply(of("user", "user_id", "reviews", "five_star", "min_text", "max_text"), number, writer, kept_already=True)
                self.weekdays.apply(of("weekday", "weekday", "reviews"), number, writer, kept_already=True)
                self.businesses.apply(of("business", "business_id", F.col("reviews").alias("funny")), number, writer, kept_already=True)
            finally:
                shares.unpersist()

    def sink(self, writer: str):
        """For streaming.run(reviews, ledger.sink(name), state): each batch is a delivery, and the query keeps no state."""
        return lambda batch, number: self.absorb(batch, number, writer)

    def last(self, writer: str = "files") -> int:
        """The last delivery of a writer that all tables have; -1 before there is one."""
        return min(t.last(writer) for t in (self.users, self.weekdays, self.businesses))

    def flows(self, business: DataFrame, users_min: int = USERS_MIN, bots_min: int = BOTS_MIN, k: int = CITIES) -> dict[str, DataFrame]:
        """The five flows, as `plans.run_all` has them."""
        profile = self.users.read()
        many = O.having_at_least(profile, users_min)
        labels = O.dimension(business).withColumn("business_id", F.col("business_id").cast("string"))
        return {
            "top_users": many.select("user_id", "reviews"),
            "best_users": many.where("reviews = five_star").select("user_id", "reviews"),
            "bot_users": O.having_at_least(profile, bots_min).where("min_text = max_text").select("user_id", "reviews"),
            "weekday_histogram": O.weekday_histogram(self.weekdays.read()),
            "funniest_cities": O.top_k(O.funny_of(self.businesses.read(), labels), k, "funny", "city"),
        }
