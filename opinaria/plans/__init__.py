"""The analytical queries, each one DataFrame plan, and their one-row text reports."""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from .. import operators as O
from ..functions import text_digest, weekday_short
from ..sources.scratch import cut, free
from ..sources.sinks import write_text

USERS_MIN, BOTS_MIN, CITIES = 50, 5, 10


def top_users(reviews: DataFrame, n: int = USERS_MIN) -> DataFrame:
    return O.having_at_least(O.count_by(O.guard(reviews), "user_id"), n)


def top_users_summary(reviews: DataFrame, n: int = USERS_MIN) -> DataFrame:
    """Users, their reviews, and the average (null without users)."""
    return (
        top_users(reviews, n)
        .agg(F.count(F.lit(1)).alias("users"), F.coalesce(F.sum("reviews"), F.lit(0)).alias("reviews"))
        .withColumn("average", F.col("reviews").cast("double") / F.when(F.col("users") > 0, F.col("users")))
    )


def best_users(reviews: DataFrame, n: int = USERS_MIN) -> DataFrame:
    """Users with at least n reviews, all with five stars."""
    return O.all_match(reviews, "user_id", F.col("stars") == 5.0, n)


def bot_users(reviews: DataFrame, n: int = BOTS_MIN) -> DataFrame:
    """Users with at least n reviews, all with the same text."""
    return O.single_valued(reviews, "user_id", "text", n)


def funniest_cities(reviews: DataFrame, business: DataFrame, k: int = CITIES) -> DataFrame:
    return O.top_k(O.funny_by_city(reviews, business), k, "funny", "city")


def _profile(reviews: DataFrame, digest: Column) -> DataFrame:
    return reviews.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("reviews"),
        F.count_if(F.col("stars") == 5.0).alias("five_star"),
        F.min(digest).alias("min_text"),
        F.max(digest).alias("max_text"),
    )


def user_profile(reviews: DataFrame) -> DataFrame:
    """Everything that the three user flows ask about a user, in one shuffle."""
    return _profile(O.guard(reviews), F.coalesce(text_digest(), F.lit("")))


def sorted_users(users: DataFrame) -> DataFrame:
    """All rows of a user query, most reviews first, then by id: a range sort, so nothing passes through one task."""
    return users.orderBy(F.desc("reviews"), F.asc("user_id"))


def run_all(reviews: DataFrame, business: DataFrame, users_min: int = USERS_MIN, bots_min: int = BOTS_MIN, k: int = CITIES) -> dict[str, DataFrame]:
    """All five flows from one scan: what they need of a review (ids, stars, funny votes, date, and the text's digest in
    place of the text) is kept while they run, and so is the profile that the three user flows share. Call `unpersist()` on
    ["scan"] and ["profile"] when done."""
    scan = reviews.select("user_id", "business_id", "stars", "funny", "review_date", F.coalesce(text_digest(), F.lit("")).alias("digest")).persist()
    profile = _profile(O.guard(scan), F.col("digest")).persist()
    many = O.having_at_least(profile, users_min)
    return {
        "scan": scan,
        "profile": profile,
        "top_users": many.select("user_id", "reviews"),
        "best_users": many.where("reviews = five_star").select("user_id", "reviews"),
        "bot_users": O.having_at_least(profile, bots_min).where("min_text = max_text").select("user_id", "reviews"),
        "weekday_histogram": O.weekday_histogram(O.weekday_counts(scan)),
        "funniest_cities": funniest_cities(scan, business, k),
    }


#: The column that names a row of each flow, and its value.
FLOWS = {"top_users": ("user_id", "reviews"), "best_users": ("user_id", "reviews"), "bot_users": ("user_id", "reviews"), "weekday_histogram": ("weekday", "reviews"), "funniest_cities": ("city", "funny")}


def together(flows: Mapping[str, DataFrame]) -> DataFrame:
    """(flow, name, value): the rows of all five flows."""
    parts = [flows[f].select(F.lit(f).alias("flow"), F.col(name).cast("string").alias("name"), F.col(value).alias("value")) for f, (name, value) in FLOWS.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def all_flows(reviews: DataFrame, business: DataFrame, users_min: int = USERS_MIN, bots_min: int = BOTS_MIN, k: int = CITIES) -> DataFrame:
    """together() of `run_all`, worked out at once and written to the scratch folder, so that nothing is kept in memory."""
    flows = run_all(reviews, business, users_min, bots_min, k)
    try:
        return cut(together(flows), "all-flows")
    finally:
        flows["profile"].unpersist()
        flows["scan"].unpersist()


# Reports: one row with one column `report`.

#: Fixed text, after a report's head.
NOBODY = "no users accomplish that requirements."


def report_top_users(reviews: DataFrame, n: int = USERS_MIN) -> DataFrame:
    said = F.format_string("%d, with %d total reviews (average: %3.2f per user).", "users", "reviews", "average")
    return top_users_summary(reviews, n).select(F.concat(F.lit(f"Users with +{n} reviews: "), F.when(F.col("users") == 0, NOBODY).otherwise(said)).alias("report"))


def _joined(df: DataFrame, number: str, label: str, item: Column) -> DataFrame:
    """One text of all rows, largest number first, then by label. The caller bounds the rows."""
    rows = F.array_sort(F.collect_list(F.struct((-F.col(number)).alias("n"), F.col(label).alias("label"), item.alias("item"))))
    return df.agg(F.array_join(F.transform(rows, lambda x: x["item"]), " ; ").alias("items"))


def _report_users(users: DataFrame, head: str) -> DataFrame:
    """Names all users. They are dealt out by range, largest number first, and each range is made one text where it lies, so
    that the last task reads a row for each range, not for each user."""
    item = F.format_string("%s (%d)", F.col("user_id").cast("string"), F.col("reviews"))
    ranges = users.repartitionByRange(F.desc("reviews"), F.asc("user_id")).withColumn("range", F.spark_partition_id())
    rows = F.array_sort(F.collect_list(F.struct((-F.col("reviews")).alias("n"), F.col("user_id").alias("label"), item.alias("item"))))
    texts = ranges.groupBy("range").agg(F.array_join(F.transform(rows, lambda x: x["item"]), " ; ").alias("items"))
    parts = F.array_sort(F.collect_list(F.struct("range", "items")))
    out = texts.agg(F.array_join(F.transform(parts, lambda x: x["items"]), " ; ").alias("items"))
    return out.select(F.concat(F.lit(head), F.when(F.col("items") == "", NOBODY).otherwise(F.col("items"))).alias("report"))


def best_head(n: int) -> str:
    return f"Users with +{n} reviews (only 5-stars): "


def bots_head(n: int) -> str:
    return f"Users with +{n} reviews (all with same text): "


def report_best_users(reviews: DataFrame, n: int = USERS_MIN) -> DataFrame:
    """The text names all of best_users()."""
    return _report_users(best_users(reviews, n), best_head(n))


def report_bot_users(reviews: DataFrame, n: int = BOTS_MIN) -> DataFrame:
    """The text names all of bot_users()."""
    return _report_users(bot_users(reviews, n), bots_head(n))


def write_user_report(users: DataFrame, head: str, out: str) -> None:
    """The same text as part files, which joined by name are the report: for any number of users, as no task or row holds
    more than its range of them."""
    item = F.format_string("%s (%d)", F.col("user_id").cast("string"), F.col("reviews"))
    users = cut(users.select("user_id", "reviews"), "report-users")  # read for the first row, for the ranges, and sorted
    write_text(users, [(-F.col("reviews")).alias("n"), F.col("user_id")], item, head, NOBODY, " ; ", out)
    free(users)


def report_weekdays(reviews: DataFrame) -> DataFrame:
    rows = O.weekday_histogram(O.weekday_counts(reviews))
    item = F.format_string("%s (%d)", weekday_short(F.col("weekday")), F.col("reviews"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("position", item.alias("item")))), lambda x: x["item"])
    return rows.agg(F.concat(F.lit("Reviews by Weekday: "), F.array_join(items, ", ")).alias("report"))


def report_cities(reviews: DataFrame, business: DataFrame, k: int = CITIES) -> DataFrame:
    item = F.format_string("%s w/ %dp", F.col("city"), F.col("funny"))
    out = _joined(funniest_cities(reviews, business, k), "funny", "city", item)
    return out.select(F.when(F.col("items") == "", "no cities have funny points.").otherwise(F.concat(F.lit("Top Funniest Cities: "), "items")).alias("report"))
