"""The registered queries of the analytics engine and their SQL."""
from __future__ import annotations

import uuid

from .. import operators as O, plans as P
from ..sources import (
    BUSINESSES, REVIEWS, first_lines, messages, read_businesses, read_reviews, read_tagged, read_with_rejects, scratch_dir,
    stream_parsed, stream_reviews, union_streams, write_results,
)
from ..sources.sizes import READS, settings
from .. import streaming as L
from ..streaming import drain
from . import testviews as V
from .ledger import Ledger

USERS, BEST, BOTS, CITIES = 50, 2, 3, 10
NONE = 1_000_000  # a threshold that nobody meets
SAMPLE, FIRST = 100, 1000
URGENT = "stars = 5 and funny >= 5 and text = '1-URGENT'"


def _written(s, d):
    """A flow's result as the sink wrote it."""
    out = f"{scratch_dir(s)}/sink-{uuid.uuid4().hex[:12]}"
    write_results({"top_users": P.top_users(V.reviews(s, d), USERS)}, out)
    return s.read.parquet(f"{out}/top_users")


def _rejects(s, d):
    """Lines that are reviews and lines that aren't, of files that hold both: each line is read and parsed once."""
    rows = read_tagged(s, V.dirty_lines(s, d), REVIEWS).selectExpr("reason is not null rejected", "if(reason is null, user_id, '(rejected)') user_id")
    return O.count_by(rows, "rejected", "user_id").drop("rejected")


def _drain(s, d, df, *how, **more):
    return drain(df, *how, rows=V.rows_of(s, d), **more)


def _folder(s, name):
    return f"{scratch_dir(s)}/{name}-{uuid.uuid4().hex[:12]}"


def _named_rejects(good, bad):
    return O.count_by(good, "user_id").unionByName(O.count_by(bad.selectExpr("'(rejected)' user_id"), "user_id"))


def _stream_rejects(s, d):
    """The same of a stream: its records and its rejects, each written batch by batch."""
    parsed, out = stream_parsed(s, V.dirty_lines(s, d), REVIEWS, maxFilesPerTrigger=V.trigger_files(s, d, 2, 64)), _folder(s, "split")
    L.split_feed(parsed, REVIEWS, out, f"{out}-state", availableNow=True).awaitTermination()
    return _named_rejects(*L.split_results(parsed, REVIEWS, out))


def _business_rejects(s, d):
    good, bad = read_with_rejects(s, V.dirty_business_lines(s, d), BUSINESSES)
    cities = O.city_labels(good).groupBy(V.F.col("city").alias("name")).agg(V.F.count(V.F.lit(1)).alias("lines"))
    return cities.unionByName(O.count_by(bad.select(V.F.col("reason").alias("name")), "name", name="lines"))


def _stream_flows(s, d):
    """All five flows of one streaming query over several batches."""
    out = _folder(s, "flows")
    flows = L.Flows(s, out, lambda: read_businesses(s, path), "flows", BOTS, BOTS, CITIES, buckets=4)
    path, live = V.business_lines(s, d), stream_reviews(s, V.ordered_lines(s, d, 4), maxFilesPerTrigger=str(2 * V.part_files(s, d, 4)))
    with settings(s, READS):
        L.run(L.flow_counts(live), flows, f"{out}-state", "update", V.rows_of(s, d), availableNow=True).awaitTermination()
    return P.together(flows.results())


def _ledger_flows(s, d):
    """Half of the reviews as a delivery of files, the others as a live feed that is merged into the stored profile."""
    out = _folder(s, "ledger")
    ledger, half, rows = Ledger(s, out, 4), V.ordered_part(s, d, 4, 0, 1), V.rows_of(s, d)
    ledger.absorb(read_reviews(s, half), 1, rows=rows)
    for i in (2, 3):
        with settings(s, READS):
            L.run(stream_reviews(s, V.ordered_part(s, d, 4, i)), ledger.sink(f"feed-{i}"), f"{out}-state-{i}", rows=rows, availableNow=True).awaitTermination()
    ledger.absorb(read_reviews(s, half), 1, rows=rows)  # again: nothing changes
    return P.together(ledger.flows(read_businesses(s, V.business_lines(s, d)), BOTS, BOTS, CITIES))


def _distinct(s, d, reviews):
    out = _folder(s, "distinct")
    with settings(s, READS):
        L.distinct_counts(reviews, out, f"{out}-state", buckets=4, rows=V.rows_of(s, d), availableNow=True).awaitTermination()
    return L.counted(reviews, out, buckets=4)


def _written_report(s, users, head):
    """The items of a report that was written in parts, the head before the first."""
    out = _folder(s, "report")
    P.write_user_report(users, head, out)
    return s.read.option("lineSep", " ; ").text(out).where("value <> ''").withColumnRenamed("value", "item")


def queries() -> dict:
    r, o, b, a = V.reviews, V.reviews_by_order, V.business, V.activity
    scan = lambda s, d: read_reviews(s, V.review_lines(s, d))
    live = lambda s, d: stream_reviews(s, V.review_lines(s, d))
    queue = lambda s, d: messages(s.readStream.format("text").load(V.review_lines(s, d)))
    return {
        "user_review_counts": lambda s, d: O.count_by(O.guard(r(s, d)), "user_id"),
        "top_users": lambda s, d: P.top_users(r(s, d), USERS),
        "top_users_summary": lambda s, d: P.top_users_summary(r(s, d), USERS),
        "five_star_counts": lambda s, d: O.count_by(O.guard(r(s, d)).where("stars = 5"), "user_id"),
        "best_users": lambda s, d: P.best_users(o(s, d), BEST),
        "best_users_by_join": lambda s, d: O.all_match_by_join(o(s, d), "user_id", V.F.col("stars") == 5, BEST),
        "distinct_text_pairs": lambda s, d: O.distinct_pairs(r(s, d)),
        "distinct_text_counts": lambda s, d: O.distinct_count(r(s, d)),
        "single_text_users": lambda s, d: O.single_valued(a(s, d)),
        "bot_users": lambda s, d: P.bot_users(a(s, d), BOTS),
        "bot_users_by_join": lambda s, d: O.single_valued_by_join(a(s, d), min_rows=BOTS),
        "weekday_counts": lambda s, d: O.weekday_counts(r(s, d)),
        "weekday_histogram": lambda s, d: O.weekday_histogram(O.weekday_counts(r(s, d))),
        "city_labels": lambda s, d: O.city_labels(b(s, d)),
        "funny_business": lambda s, d: O.funny_by_business(r(s, d)),
        "funny_city": lambda s, d: O.funny_by_city(r(s, d), b(s, d)),
        "funniest_cities": lambda s, d: P.funniest_cities(r(s, d), b(s, d), CITIES),
        "user_profile": lambda s, d: P.user_profile(r(s, d)),
        "reviewed_businesses": lambda s, d: O.reviewed(b(s, d), r(s, d).where(URGENT)),
        "reviewed_businesses_all": lambda s, d: O.reviewed(b(s, d), r(s, d)),
        "report_top_users": lambda s, d: P.report_top_users(r(s, d), USERS),
        "report_best_users": lambda s, d: P.report_best_users(o(s, d), BEST),
        "report_bot_users": lambda s, d: P.report_bot_users(a(s, d), BOTS),
        "report_weekdays": lambda s, d: P.report_weekdays(r(s, d)),
        "report_cities": lambda s, d: P.report_cities(r(s, d), b(s, d), CITIES),
        "best_users_sorted": lambda s, d: P.sorted_users(P.best_users(o(s, d), BEST)),
        "bot_users_sorted": lambda s, d: P.sorted_users(P.bot_users(a(s, d), BOTS)),
        "report_top_users_none": lambda s, d: P.report_top_users(r(s, d), NONE),
        "report_best_users_none": lambda s, d: P.report_best_users(o(s, d), NONE),
        "report_bot_users_none": lambda s, d: P.report_bot_users(a(s, d), NONE),
        "all_flows": lambda s, d: P.all_flows(r(s, d), b(s, d), USERS, BOTS, CITIES),
        "sink_top_users": _written,
        "scan_rejects": _rejects,
        "sample_size": lambda s, d: O.sample_reviews(r(s, d), SAMPLE, r(s, d).where(URGENT)).agg(V.F.count(V.F.lit(1)).alias("reviews")),
        "stream_union_top_users": lambda s, d: _drain(s, d, P.top_users(union_streams(live(s, d), queue(s, d)), BOTS)),
        "scan_top_users": lambda s, d: P.top_users(scan(s, d), BOTS),
        "scan_best_users": lambda s, d: P.best_users(scan(s, d), BEST),
        "scan_weekday_counts": lambda s, d: O.weekday_counts(scan(s, d)),
        "scan_funniest_cities": lambda s, d: P.funniest_cities(scan(s, d), read_businesses(s, V.business_lines(s, d)), CITIES),
        "stream_scan_best_users": lambda s, d: _drain(s, d, P.best_users(live(s, d), BEST)),
        "stream_scan_funniest_cities": lambda s, d: _drain(s, d, P.funniest_cities(live(s, d), read_businesses(s, V.business_lines(s, d)), CITIES)),
        "stream_messages_top_users": lambda s, d: _drain(s, d, P.top_users(queue(s, d), BOTS)),
        "stream_top_users": lambda s, d: _drain(s, d, P.top_users(r(s, d, True), USERS)),
        "stream_best_users": lambda s, d: _drain(s, d, P.best_users(o(s, d, True), BEST)),
        "stream_bot_users": lambda s, d: _drain(s, d, P.bot_users(a(s, d, True), BOTS)),
        "stream_weekday_counts": lambda s, d: _drain(s, d, O.weekday_counts(r(s, d, True))),
        "stream_funniest_cities": lambda s, d: _drain(s, d, P.funniest_cities(r(s, d, True), b(s, d), CITIES)),
        "stream_all_flows": _stream_flows,
        "stream_update_user_counts": lambda s, d: _drain(s, d, O.count_by(O.guard(stream_reviews(s, V.ordered_lines(s, d, 4), maxFilesPerTrigger=str(V.part_files(s, d, 4)))), "user_id"), "update", keys=["user_id"], buckets=4),
        "stream_update_user_profile": lambda s, d: _drain(s, d, P.user_profile(r(s, d, True)), "update", keys=["user_id"], buckets=4),
        "stream_distinct_text_pairs": lambda s, d: _drain(s, d, O.distinct_pairs(r(s, d, True)), "append", keys=["user_id", "hashed_text"], buckets=4, merge={}),
        "stream_distinct_text_counts": lambda s, d: _distinct(s, d, r(s, d, True)),
        "stream_scan_rejects": _stream_rejects,
        "scan_business_rejects": _business_rejects,
        "ledger_flows": _ledger_flows,
        "first_reviews": lambda s, d: messages(first_lines(s, V.ordered_lines(s, d), FIRST)).select("review_id", "user_id", "funny"),
        "report_best_users_parts": lambda s, d: _written_report(s, P.best_users(o(s, d), BEST), P.best_head(BEST)),
        "report_bot_users_parts": lambda s, d: _written_report(s, P.bot_users(a(s, d), BOTS), P.bots_head(BOTS)),
        "funny_city_by_shuffle": lambda s, d: O.funny_by_city(r(s, d), b(s, d), 0, 0),
        "stream_funny_city_by_broadcast": lambda s, d: _drain(s, d, O.funny_by_city(r(s, d, True), b(s, d))),
        "stream_funny_city_by_shuffle": lambda s, d: _drain(s, d, O.funny_by_city(r(s, d, True), b(s, d), 0, 0)),
    }


def oracle_sql() -> dict[str, str]:
    label = "concat(coalesce(city, ''), ' (', coalesce(state, ''), ')')"
    cities = f"select {label} city, count(*) funny from reviews join business using (business_id) where funny > 0 group by 1"
    counts = "select user_id, count(*) reviews from reviews group by user_id"
    best_of = lambda n: f"select user_id, count(*) reviews from reviews_by_order group by user_id having count(*) >= {n} and count(*) = count(*) filter (where stars = 5)"
    bots_of = lambda n: f"select user_id, count(*) reviews from activity group by user_id having count(distinct md5(text)) = 1 and count(*) >= {n}"
    best, bots = best_of(BEST), bots_of(BOTS)
    top_report = lambda n: f"select concat('Users with +{n} reviews: ', case when users = 0 then 'no users accomplish that requirements.' else printf('%d, with %d total reviews (average: %3.2f per user).', users, reviews, average) end) report from ({summary(n)})"
    days = "(values (0, 'Sunday'), (1, 'Monday'), (2, 'Tuesday'), (3, 'Wednesday'), (4, 'Thursday'), (5, 'Friday'), (6, 'Saturday')) d(position, weekday)"
    byday = "select dayname(date) weekday, count(*) reviews from reviews group by 1"
    week = f"select d.position, d.weekday, cast(coalesce(c.reviews, 0) as bigint) reviews from {days} left join ({byday}) c on d.weekday = c.weekday"
    summary = lambda n: f"select count(*) users, cast(coalesce(sum(reviews), 0) as bigint) reviews, sum(reviews) / count(*) average from ({counts} having count(*) >= {n})"
    users = "concat(cast(user_id as varchar), ' (', cast(reviews as varchar), ')')"
    named = lambda head, sql: f"select concat('{head}', coalesce(string_agg({users}, ' ; ' order by reviews desc, user_id), 'no users accomplish that requirements.')) report from ({sql})"
    top = f"{cities} order by funny desc, city limit {CITIES}"
    sql = {
        "user_review_counts": counts,
        "top_users": f"{counts} having count(*) >= {USERS}",
        "top_users_summary": summary(USERS),
        "five_star_counts": "select user_id, count(*) reviews from reviews where stars = 5 group by user_id",
        "best_users": best,
        "best_users_by_join": best,
        "distinct_text_pairs": "select distinct user_id, md5(text) hashed_text from reviews",
        "distinct_text_counts": 'select user_id, count(distinct md5(text)) "distinct" from reviews group by user_id',
        "single_text_users": "select user_id, count(*) reviews from activity group by user_id having count(distinct md5(text)) = 1",
        "bot_users": bots,
        "bot_users_by_join": bots,
        "weekday_counts": byday,
        "weekday_histogram": week,
        "city_labels": f"select business_id, {label} city from business",
        "funny_business": "select business_id, count(*) funny from reviews where funny > 0 group by business_id",
        "funny_city": cities,
        "funniest_cities": top,
        "user_profile": "select user_id, count(*) reviews, count(*) filter (where stars = 5) five_star, min(md5(text)) min_text, max(md5(text)) max_text from reviews group by user_id",
        "reviewed_businesses": f"select * from business where business_id in (select business_id from reviews where {URGENT})",
        "reviewed_businesses_all": "select * from business where business_id in (select business_id from reviews)",
        "report_top_users": top_report(USERS),
        "report_best_users": named(f"Users with +{BEST} reviews (only 5-stars): ", best),
        "report_bot_users": named(f"Users with +{BOTS} reviews (all with same text): ", bots),
        "report_weekdays": f"select concat('Reviews by Weekday: ', string_agg(concat(upper(weekday[1:3]), ' (', cast(reviews as varchar), ')'), ', ' order by position)) report from ({week})",
        "report_cities": f"select case when count(*) = 0 then 'no cities have funny points.' else concat('Top Funniest Cities: ', string_agg(concat(city, ' w/ ', cast(funny as varchar), 'p'), ' ; ' order by funny desc, city)) end report from ({top})",
    }
    text_key = lambda q: f"select * replace (cast(user_id as varchar) as user_id) from ({q})"
    many = f"select user_id, count(*) reviews from reviews_by_order group by user_id having count(*) >= {BOTS}"
    flow = lambda name, key, value, q: f"select '{name}' flow, cast({key} as varchar) as name, {value} as value from ({q})"
    best_plain = f"select user_id, count(*) reviews from reviews group by user_id having count(*) >= {USERS} and count(*) = count(*) filter (where stars = 5)"
    bots_plain = f"select user_id, count(*) reviews from reviews group by user_id having count(distinct md5(text)) = 1 and count(*) >= {BOTS}"
    sql |= {
        "best_users_sorted": best,
        "bot_users_sorted": bots,
        "report_top_users_none": top_report(NONE),
        "report_best_users_none": named(f"Users with +{NONE} reviews (only 5-stars): ", best_of(NONE)),
        "report_bot_users_none": named(f"Users with +{NONE} reviews (all with same text): ", bots_of(NONE)),
        "all_flows": " union all ".join((
            flow("top_users", "user_id", "reviews", sql["top_users"]), flow("best_users", "user_id", "reviews", best_plain), flow("bot_users", "user_id", "reviews", bots_plain),
            flow("weekday_histogram", "weekday", "reviews", week), flow("funniest_cities", "city", "funny", top))),
        "sink_top_users": sql["top_users"],
        "scan_rejects": "select cast(user_id as varchar) user_id, count(*) reviews from reviews_by_order where funny <> 1 group by user_id union all select '(rejected)', count(*) from reviews_by_order where funny = 1 having count(*) > 0",
        "sample_size": f"select least({SAMPLE}, (select count(*) from reviews)) + count(*) reviews from reviews where {URGENT}",
        "stream_union_top_users": text_key(f"select user_id, 2 * count(*) reviews from reviews_by_order group by user_id having 2 * count(*) >= {BOTS}"),
        "scan_top_users": text_key(many),
        "scan_best_users": text_key(best),
        "scan_weekday_counts": byday,
        "scan_funniest_cities": top,
        "stream_scan_best_users": text_key(best),
        "stream_scan_funniest_cities": top,
        "stream_messages_top_users": text_key(many),
    }
    many_of = lambda name, where: flow(name, "user_id", "reviews", f"select user_id, count(*) reviews from reviews_by_order group by user_id having {where} and count(*) >= {BOTS}")
    five = " union all ".join((
        many_of("top_users", "true"), many_of("best_users", "count(*) = count(*) filter (where stars = 5)"), many_of("bot_users", "count(distinct md5(text)) = 1"),
        flow("weekday_histogram", "weekday", "reviews", week), flow("funniest_cities", "city", "funny", top)))
    items = lambda head, q: f"select concat(case when row_number() over (order by reviews desc, user_id) = 1 then '{head}' else '' end, {users}) item from ({q})"
    kind = "case when business_id % 5 = 0 or business_id % 11 = 0 then 'not one JSON object' when business_id % 7 = 0 then 'no business_id' end"
    sql |= {
        "stream_all_flows": five,
        "ledger_flows": five,
        "stream_update_user_counts": text_key("select user_id, count(*) reviews from reviews_by_order group by user_id"),
        "stream_update_user_profile": sql["user_profile"],
        "stream_scan_rejects": sql["scan_rejects"],
        "scan_business_rejects": f"select coalesce({kind}, {label}) as name, count(*) lines from business group by 1",
        "first_reviews": f"select review_id, cast(user_id as varchar) user_id, cast(funny as bigint) funny from reviews_by_order r order by r.user_id, cast(split_part(review_id, '-', 2) as bigint), funny limit {FIRST}",
        "report_best_users_parts": items(P.best_head(BEST), best),
        "report_bot_users_parts": items(P.bots_head(BOTS), bots),
        "funny_city_by_shuffle": cities,
        "stream_funny_city_by_broadcast": cities,
        "stream_funny_city_by_shuffle": cities,
    }
    sql |= {f"stream_{k}": sql[k] for k in ("distinct_text_pairs", "distinct_text_counts")}
    sql |= {f"stream_{k}": sql[k] for k in ("top_users", "best_users", "bot_users", "weekday_counts", "funniest_cities")}
    return {k: V.CTE + v for k, v in sql.items()}
