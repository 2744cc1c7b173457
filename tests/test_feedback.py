"""The five user groups, dirty input, boundaries, and streams against batch."""
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from opinaria import operators as O, plans as P
from opinaria.sources import cut, free, messages, read_businesses, read_reviews, read_reviews_with_rejects, scoped, stream_reviews, union_streams, write_results
from opinaria.streaming import drain, newest, start


def review(user, i, text, stars=5.0, funny=0, date="2019-12-07 13:32:11", **more):
    return {"review_id": f"{user}-{i}", "user_id": user, "business_id": f"b{i % 9}", "stars": stars, "useful": 0, "funny": funny, "cool": 0, "text": text, "date": date} | more


def groups():
    rows = [review("bot", i, "Buy now") for i in range(6)]
    rows += [review("top-1", i, f"one {i}", 5.0 if i < 20 else 3.0, int(i < 6)) for i in range(50)]
    rows += [rows[-1]]
    rows += [review("top-2", i, f"two {i}", 5.0 if i < 58 else 1.0, 2 * (i < 21)) for i in range(117)]
    rows += [review("top-3", i, f"three {i}", 5.0 if i < 35 else 2.0, 3 * (i < 13)) for i in range(74)]
    rows += [review("best", i, f"best {i}", 5.0, 4 * (i < 17)) for i in range(56)]
    random.Random(1).shuffle(rows)
    return rows


BUSINESSES = [{"business_id": f"b{i}", "city": "Élan" if i < 3 else ("" if i == 3 else "Springfield"), "state": "AZ" if i % 2 else "NV", "hours": {"Monday": "9-5"}, "attributes": None} for i in range(9)]


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("in")
    (d / "r").mkdir()
    (d / "r" / "a.json").write_text("\n".join(map(json.dumps, groups())))
    (d / "b.json").write_text("\n".join(map(json.dumps, BUSINESSES + BUSINESSES[:4])))
    return read_reviews(spark, str(d / "r")), read_businesses(spark, str(d / "b.json")), d


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_groups(data):
    r, b, _ = data
    assert tuple(P.top_users_summary(r).first()) == (4, 298, 74.5)
    assert rows(P.best_users(r)) == [("best", 56)]
    assert rows(P.bot_users(r)) == [("bot", 6)]
    assert O.funny_reviews(r).count() == 57
    assert sum(x[1] for x in rows(O.funny_by_city(r, b))) == 57
    assert P.report_best_users(r).first()[0] == "Users with +50 reviews (only 5-stars): best (56)"
    assert P.report_top_users(r).first()[0] == "Users with +50 reviews: 4, with 298 total reviews (average: 74.50 per user)."
    assert P.report_weekdays(r).first()[0] == "Reviews by Weekday: SUN (0), MON (0), TUE (0), WED (0), THU (0), FRI (0), SAT (304)"


def test_run_all_and_sink(data, spark, tmp_path):
    r, b, _ = data
    out = P.run_all(r, b)
    profile, scan = out.pop("profile"), out.pop("scan")
    assert "text" not in scan.columns and scan.storageLevel.useMemory
    for df in out.values():  # every flow starts from what is kept
        assert "InMemoryTableScan" in df._jdf.queryExecution().executedPlan().toString() and rows(df) is not None
    assert rows(out["best_users"]) == rows(P.best_users(r)) and rows(out["bot_users"]) == rows(P.bot_users(r)) and rows(out["top_users"]) == rows(P.top_users(r))
    write_results(out, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/funniest_cities")).count() == out["funniest_cities"].count()
    profile.unpersist()
    scan.unpersist()


def test_forms_agree(data):
    r, _, _ = data
    for n in (1, 5, 50, 57):
        assert rows(O.all_match(r, "user_id", F.col("stars") == 5, n)) == rows(O.all_match_by_join(r, "user_id", F.col("stars") == 5, n))
        assert rows(O.single_valued(r, min_rows=n)) == rows(O.single_valued_by_join(r, min_rows=n))


def test_stream_equals_batch(data, spark):
    r, b, d = data
    live = d / "live"
    live.mkdir(exist_ok=True)
    (live / "x.json").write_text("\n".join(json.dumps(review("late", i, "late", "5", "1")) for i in range(50)))
    both = read_reviews(spark, str(d / "r")).unionByName(read_reviews(spark, str(live)))
    s = lambda: union_streams(stream_reviews(spark, str(d / "r")), stream_reviews(spark, str(live)))
    for f in (P.top_users, P.best_users, P.bot_users, O.weekday_counts):
        assert rows(drain(f(s()))) == rows(f(both))
    assert rows(drain(P.funniest_cities(s(), b))) == rows(P.funniest_cities(both, b))
    assert ("late", 50) in rows(P.best_users(both))


def test_dirty(spark, tmp_path):
    good = review("u", 1, "x" * 100_000)
    lines = [json.dumps(good), "", "not json", json.dumps({k: v for k, v in good.items() if k != "funny"}), json.dumps(dict.fromkeys(good)),
             json.dumps(good | {"stars": "5", "funny": "3"}), json.dumps(good | {"user_id": ""}), *(json.dumps(good | {"date": x}) for x in ("bad", "", "2019-02-30"))]
    (tmp_path / "d.json").write_text("\n".join(lines))
    r, bad = read_reviews_with_rejects(spark, str(tmp_path / "d.json"))
    assert r.count() == 8 and [x.line for x in bad.collect()] == ["not json"]
    assert rows(O.count_by(O.guard(r), "user_id")) == [("u", 6)]
    assert rows(O.weekday_counts(r)) == [("Saturday", 4)]
    assert O.funny_reviews(r).count() == 1 and r.where("stars = 5").count() == 7
    assert rows(P.top_users(r.limit(0))) == [] and P.report_cities(r.limit(0), r.limit(0).selectExpr("business_id", "text city", "text state")).first()[0] == "no cities have funny points."
    assert P.report_bot_users(r.limit(0)).first()[0] == "Users with +5 reviews (all with same text): no users accomplish that requirements."
    assert P.report_top_users(r.limit(0)).first()[0] == "Users with +50 reviews: no users accomplish that requirements."


def test_case_and_space_count(spark):
    df = spark.createDataFrame([("a", "Hi"), ("a", "hi"), ("a", "hi "), ("b", "hi"), ("b", "hi")], "user_id string, text string")
    assert rows(O.distinct_count(df)) == [("a", 3), ("b", 1)]


@pytest.mark.parametrize("n", [0, -1, True, 1.5])
def test_thresholds(data, n):
    with pytest.raises(ValueError):
        P.top_users(data[0], n)


def test_ties_and_semi_join(data, spark):
    df = spark.createDataFrame([("z", 1), ("a", 1), ("m", 1)], "city string, funny long")
    assert [x.city for x in O.top_k(df, 2, "funny", "city").collect()] == ["a", "m"]
    r, b, _ = data
    assert O.reviewed(b, O.sample_reviews(r, 3)).count() >= 1


def test_sorted_users(spark):
    df = spark.createDataFrame([("b", 2), ("a", 2), ("c", 9)], "user_id string, reviews long")
    assert [x.user_id for x in P.sorted_users(df).collect()] == ["c", "a", "b"]


def test_empty_stream(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert rows(drain(P.top_users(stream_reviews(spark, str(tmp_path / "none"))))) == []


def test_newest_result(spark, tmp_path):
    """Two runs over a growing folder: the second result stands for all, and nothing is lost between; other modes are
    refused."""
    (tmp_path / "in").mkdir()
    plan = O.count_by(O.guard(stream_reviews(spark, str(tmp_path / "in"))), "user_id")
    assert newest(plan, str(tmp_path / "out")).count() == 0
    for i in range(4):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps(review("u", j, "t")) for j in range(3)) + "\n" + json.dumps(review(f"v{i}", 0, "t")))
        start(plan, str(tmp_path / "out"), str(tmp_path / "state"), availableNow=True).awaitTermination()
        assert rows(newest(plan, str(tmp_path / "out"))) == sorted([("u", 3 * i + 3), *((f"v{j}", 1) for j in range(i + 1))])
    assert len(list((tmp_path / "out").iterdir())) == 2
    for mode in ("update", "append"):
        with pytest.raises(ValueError):
            start(plan, str(tmp_path / "out"), str(tmp_path / "state2"), mode)


def test_messages(spark):
    """Text or bytes, as a queue gives them; what isn't a review gives none."""
    good = json.dumps(review("u", 1, "x", "5", "3"))
    for kind in ("string", "binary"):
        df = spark.createDataFrame([(good,), (None,), (" ",), ("not json",)], "value string").selectExpr(f"cast(value as {kind}) value")
        assert [(x.user_id, x.stars, x.funny) for x in messages(df).collect()] == [("u", 5.0, 3)]


def test_scoped_tables(spark):
    """Tables cut in a block are gone after it, freed ones at once, others stay."""
    with scoped(spark):
        inside = cut(spark.range(3), "t")
        assert inside.count() == 3
    outside = cut(spark.range(4), "t")
    assert outside.count() == 4
    free(outside, spark.range(1))
    for df in (inside, outside):
        assert not os.path.exists(df._scratch_path)
