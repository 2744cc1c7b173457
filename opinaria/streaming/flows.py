"""All five flows from one streaming query.

Every review becomes one row for its user, one for its weekday and, with funny votes, one for its business. One aggregate over
(kind, key) holds the state of all flows: a fixed number of fields for each user, business and weekday. Tasks add up their rows
before they shuffle, so the seven weekdays are no hot keys. What a batch changed goes to a sink for each flow, and each
sink commits the batch's number; a batch that comes again finds it there."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .. import operators as O, plans as P
from ..functions import has_id, text_digest, weekday_name
from ..sources.keyed import KeyedTable, committed
from ..sources.scratch import remove

_L, _S = T.LongType(), T.StringType()
_BY_USER = T.StructType([T.StructField("user_id", _S), T.StructField("reviews", _L)])
_BY_DAY = T.StructType([T.StructField("weekday", _S), T.StructField("reviews", _L)])
_BY_BUSINESS = T.StructType([T.StructField("business_id", _S), T.StructField("funny", _L)])
_BY_CITY = T.StructType([T.StructField("city", _S), T.StructField("funny", _L)])


def flow_counts(reviews: DataFrame) -> DataFrame:
    """(kind, key, reviews, five_star, min_text, max_text) of users, weekdays and businesses with funny votes, from one pass; keys
    as text."""
    digest = F.coalesce(text_digest(), F.lit(""))
    five = F.coalesce(F.col("stars") == 5.0, F.lit(False))

    def row(kind: str, key, *, profile: bool = False):
        none = F.lit(None).cast("string")
        return F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"), (five if profile else F.lit(False)).alias("five"), (digest if profile else none).alias("digest"))

    rows = F.array(
        F.when(F.coalesce(has_id("user_id"), F.lit(False)), row("user", F.col("user_id"), profile=True)),
        F.when(F.col("review_date").isNotNull(), row("weekday", weekday_name())),
        F.when((F.col("funny") > 0) & F.col("business_id").isNotNull(), row("business", F.col("business_id"))),
    )
    one = reviews.select(F.explode(rows).alias("r")).where("r is not null").select("r.*")
    return one.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("reviews"), F.count_if("five").alias("five_star"), F.min("digest").alias("min_text"), F.max("digest").alias("max_text"))


def consume(batch: DataFrame) -> None:
    """Works a batch out for its state alone: a batch that comes again brings the query's state up to date, too."""
    batch.write.format("noop").mode("overwrite").save()


class Flows:
    """The sinks of the five flows under `out`, for `run(flow_counts(reviews), flows, state, "update")`.

    `business` is called for each batch, so the cities are those of the businesses as they are then, for old reviews too. The
    three user flows and the weekdays are keyed tables, in which a batch changes the rows it touches (a user who stops being
    a best user goes); the funny votes by business are one, too, from which the cities are worked out."""

    def __init__(self, spark: SparkSession, out: str, business: Callable[[], DataFrame], writer: str = "flows", users_min: int = P.USERS_MIN, bots_min: int = P.BOTS_MIN, k: int = P.CITIES, buckets: int = 16):
        self.spark, self.out, self.business, self.writer, self.k = spark, out, business, writer, k
        self.users_min, self.bots_min = O.at_least_one(users_min, "the threshold"), O.at_least_one(bots_min, "the threshold")
        self.tables = {name: KeyedTable(spark, f"{out}/{name}", _BY_USER, ["user_id"], buckets) for name in ("top_users", "best_users", "bot_users")}
        self.tables["weekdays"] = KeyedTable(spark, f"{out}/weekdays", _BY_DAY, ["weekday"], 1)
        self.tables["businesses"] = KeyedTable(spark, f"{out}/businesses", _BY_BUSINESS, ["business_id"], buckets)

    def __call__(self, batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            users = batch.where("kind = 'user'").select(F.col("key").alias("user_id"), "reviews", "five_star", "min_text", "max_text")
            many, bots = F.col("reviews") >= self.users_min, F.col("reviews") >= self.bots_min
            new = False
            for name, member in (("top_users", many), ("best_users", many & (F.col("reviews") == F.col("five_star"))), ("bot_users", bots & (F.col("min_text") == F.col("max_text")))):
                new |= self._route(name, users, number, ~member)
            new |= self._route("weekdays", batch.where("kind = 'weekday'").select(F.col("key").alias("weekday"), "reviews"), number)
            new |= self._route("businesses", batch.where("kind = 'business'").select(F.col("key").alias("business_id"), F.col("reviews").alias("funny")), number)
            if not new:
                consume(batch)
        finally:
            batch.unpersist()
        self._cities(number)

    def _route(self, name: str, rows: DataFrame, number: int, deleted=None) -> bool:
        return self.tables[name].apply(rows, number, self.writer, deleted, kept_already=True)

    def _cities(self, number: int) -> None:
        if number in committed(self.spark, f"{self.out}/cities", "batch"):
            return
        labels = O.dimension(self.business()).withColumn("business_id", F.col("business_id").cast("string"))
        cities = O.top_k(O.funny_of(self.tables["businesses"].read(self.writer, number), labels), self.k, "funny", "city")
        cities.write.mode("overwrite").parquet(f"{self.out}/cities/batch={number}")
        for old in committed(self.spark, f"{self.out}/cities", "batch")[:-2]:
            remove(self.spark, f"{self.out}/cities/batch={old}")

    def committed(self) -> int:
        """The last batch that every sink has; the cities are written last."""
        return max(committed(self.spark, f"{self.out}/cities", "batch"), default=-1)

    def results(self) -> dict[str, DataFrame]:
        """The five flows as of the last batch that every sink has."""
        number = self.committed()
        read = lambda name: self.tables[name].read(self.writer, number)
        cities = self.spark.read.schema(_BY_CITY).parquet(f"{self.out}/cities/batch={number}") if number >= 0 else self.spark.createDataFrame([], _BY_CITY)
        out = {name: read(name) for name in ("top_users", "best_users", "bot_users")}
        return out | {"weekday_histogram": O.weekday_histogram(read("weekdays")), "funniest_cities": cities}
