"""Stored tables, streams into them, rejects, heads in file order, reports in parts."""
import glob
import json
import os
import random

import pytest
from pyspark.sql import functions as F, types as T

from opinaria import operators as O, plans as P, streaming as L
from opinaria.plans.ledger import Ledger
from opinaria.sources import BUSINESSES, REVIEWS, KeyedTable, first_lines, read_businesses, read_reviews, read_with_rejects, stream_parsed, stream_reviews
from tests.test_feedback import BUSINESSES as SHOPS, groups, review, rows

USERS = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("reviews", T.LongType())])


def named(spark, *pairs):
    return spark.createDataFrame(list(pairs), USERS)


def test_rows_replace_and_go(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), USERS, ["user_id"], 4)
    assert t.read().count() == 0 and t.last("w") == -1
    assert t.apply(named(spark, ("a", 1), ("b", 2), ("c", 3)), 0, "w")
    assert t.apply(named(spark, ("b", 5), ("c", 0), ("d", 4)), 1, "w", F.col("reviews") == 0)
    assert rows(t.read()) == [("a", 1), ("b", 5), ("d", 4)] and t.last("w") == 1
    assert not t.apply(named(spark, ("a", 99)), 1, "w") and not t.apply(named(spark, ("a", 99)), 0, "w")
    assert rows(t.read("w", 0)) == [("a", 1), ("b", 2), ("c", 3)] and rows(t.read("w", -1)) == []
    assert t.apply(named(spark), 2, "w") and rows(t.read()) == [("a", 1), ("b", 5), ("d", 4)]
    with pytest.raises(LookupError):  # two states are kept
        t.read("w", 0)
    assert t.apply(named(spark, ("a", 0), ("b", 0), ("d", 0), (None, 7)), 3, "w", F.col("reviews") == 0)
    assert rows(t.read()) == [(None, 7)] and rows(t.read("w", 2)) == [("a", 1), ("b", 5), ("d", 4)]
    again = KeyedTable(spark, str(tmp_path / "t"), USERS, ["user_id"], 4)
    assert rows(again.read()) == [(None, 7)] and again.last("w") == 3
    assert again.apply(named(spark, (None, 8)), 4, "w") and rows(again.read()) == [(None, 8)]
    assert len(glob.glob(str(tmp_path / "t/commits/version=*.json"))) == 2
    with pytest.raises(ValueError):
        KeyedTable(spark, str(tmp_path / "t"), USERS, ["user_id"], 5).read()
    with pytest.raises(ValueError):
        KeyedTable(spark, str(tmp_path / "u"), USERS, ["user_id"], 4, {"reviews": "avg"})


def test_failure_before_the_commit(spark, tmp_path, monkeypatch):
    t = KeyedTable(spark, str(tmp_path / "t"), USERS, ["user_id"], 4, {"reviews": "sum"})
    t.apply(named(spark, ("a", 1), ("b", 2)), 0, "w")
    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            t.apply(named(spark, ("a", 10)), 1, "w")
    assert rows(t.read()) == [("a", 1), ("b", 2)]
    assert t.apply(named(spark, ("a", 10)), 1, "w") and rows(t.read()) == [("a", 11), ("b", 2)]
    stale = KeyedTable(spark, str(tmp_path / "t"), USERS, ["user_id"], 4, {"reviews": "sum"})
    state = stale._newest()
    t.apply(named(spark, ("a", 1)), 2, "w")
    with pytest.raises(RuntimeError):  # another writer was faster
        stale._commit(state._replace(version=state.version + 1))


def test_shares_in_any_order(spark, tmp_path):
    """A profile that is merged from deliveries is that of one scan, whatever their order; each counts once."""
    all_of, parts = groups(), []
    shops = spark.createDataFrame([(x["business_id"], x["city"], x["state"]) for x in SHOPS], "business_id string, city string, state string")
    for i in range(4):
        path = tmp_path / f"part{i}.json"
        path.write_text("\n".join(map(json.dumps, all_of[i::4])))
        parts.append(read_reviews(spark, str(path)))
    want = {k: rows(v) for k, v in P.run_all(read_reviews(spark, str(tmp_path / "part*.json")), shops).items() if k in P.FLOWS}
    for order in ([0, 1, 2, 3], [3, 1, 0, 2]):
        ledger = Ledger(spark, str(tmp_path / f"ledger{order[0]}"), 3)
        for i in order:
            ledger.absorb(parts[i], 1, f"delivery {i}")
            ledger.absorb(parts[i], 1, f"delivery {i}")
        assert {k: rows(v) for k, v in ledger.flows(shops).items()} == want
        assert ledger.last("delivery 2") == 1 and ledger.last("nobody") == -1


def replay(state):
    """Makes the query forget that it finished its last batch, as after a failure at its end."""
    last = max(glob.glob(f"{state}/commits/[0-9]*"), key=lambda p: int(os.path.basename(p)))
    os.remove(last)
    for crc in glob.glob(f"{os.path.dirname(last)}/.{os.path.basename(last)}.crc"):
        os.remove(crc)


def arrive(folder, i, lines):
    folder.mkdir(exist_ok=True)
    (folder / f"{i}.json").write_text("\n".join(lines))


def test_update_mode(spark, tmp_path):
    """After several triggers and a batch that came twice, a keyed sink holds what batch SQL gives."""
    r, feed, out, state = random.Random(1), tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    feed.mkdir()
    plan = P.user_profile(stream_reviews(spark, str(feed)))
    how = {"keys": ["user_id"], "buckets": 3}
    for i in range(3):
        arrive(feed, i, [json.dumps(review(f"u{r.randrange(9)}", j, f"t{r.randrange(3)}", r.choice([4.0, 5.0]))) for j in range(40)])
        L.start(plan, out, state, "update", **how, availableNow=True).awaitTermination()
        if i == 1:
            replay(state)
    read_reviews(spark, str(feed)).createOrReplaceTempView("all_reviews")
    want = spark.sql("select user_id, count(*), count_if(stars = 5), min(md5(text)), max(md5(text)) from all_reviews group by user_id")
    assert rows(L.newest(plan, out, **how)) == rows(want)
    for mode, more in (("update", {}), ("append", {"keys": ["user_id"]}), ("update", {"keys": ["user_id"], "merge": {}})):
        with pytest.raises(ValueError):
            L.start(plan, out, state, mode, **more)


def test_distinct_texts(spark, tmp_path):
    """Texts that come back in later triggers count once, a batch that came twice too."""
    r, feed, out, state = random.Random(2), tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    feed.mkdir()
    live = stream_reviews(spark, str(feed))
    for i in range(3):
        arrive(feed, i, [json.dumps(review("hot" if j % 3 else f"u{j % 7}", j, f"t{r.randrange(30)}")) for j in range(60)] + [json.dumps(review("", 1, "x")), json.dumps(review("none", 1, None))])
        L.distinct_counts(live, out, state, buckets=3, availableNow=True).awaitTermination()
        if i == 1:
            replay(state)
    assert rows(L.counted(live, out, buckets=3)) == rows(O.distinct_count(read_reviews(spark, str(feed))))


def test_five_flows_of_one_stream(spark, tmp_path, monkeypatch):
    """Several triggers, one of them failing between two sinks; users who stop being best; cities that change their name."""
    feed, shops, out, state = tmp_path / "in", tmp_path / "shops.json", str(tmp_path / "out"), str(tmp_path / "state")
    shops.write_text("\n".join(map(json.dumps, SHOPS)))
    business = lambda: read_businesses(spark, str(shops))
    flows = L.Flows(spark, out, business, "live", 5, 3, 4, buckets=3)
    assert flows.committed() == -1 and [v.count() for v in flows.results().values()] == [0, 0, 0, 7, 0]
    feed.mkdir()
    counts = L.flow_counts(stream_reviews(spark, str(feed)))
    trigger = lambda: L.run(counts, flows, state, "update", availableNow=True)

    def check():
        want = P.run_all(read_reviews(spark, str(feed)), business(), 5, 3, 4)
        got = flows.results()
        assert {k: rows(v) for k, v in got.items()} == {k: rows(v) for k, v in want.items() if k in P.FLOWS}
        for kept in ("profile", "scan"):
            want[kept].unpersist()
        return got

    every = [json.dumps(x) for x in groups()]
    arrive(feed, 0, every[::2] + [json.dumps(review("fading", i, f"f{i}")) for i in range(6)] + ["not json", json.dumps(review(None, 1, "x", date="none"))])
    trigger().awaitTermination()
    assert ("fading", 6) in rows(check()["best_users"])
    arrive(feed, 1, every[1::2] + [json.dumps(review("fading", 7, "f7", 1.0))])
    with monkeypatch.context() as m:
        route = L.Flows._route
        m.setattr(L.Flows, "_route", lambda self, name, *a: (_ for _ in ()).throw(RuntimeError("lost")) if name == "bot_users" else route(self, name, *a))
        with pytest.raises(Exception, match="lost"):
            trigger().awaitTermination()
    assert flows.committed() == 0 and flows.tables["top_users"].last("live") == 1
    assert ("fading", 6) in rows(flows.results()["top_users"])  # as of the last batch that all sinks have
    trigger().awaitTermination()
    assert ("fading", 6) not in rows(check()["best_users"]) and flows.committed() == 1
    replay(state)
    trigger().awaitTermination()
    check()
    shops.write_text("\n".join(json.dumps(x | {"city": "Renamed"}) for x in SHOPS))
    arrive(feed, 2, [json.dumps(review("late", 1, "x", 5.0, 1))])
    trigger().awaitTermination()
    assert all(c.startswith("Renamed") for c, _ in rows(check()["funniest_cities"]))


GOOD = review("u", 1, 'a ] } "quoted" [1] text')
LINES = [json.dumps(GOOD), "", " \t", "not json", json.dumps(GOOD)[:30], json.dumps(GOOD) + ' {"user_id": "x"}', json.dumps(GOOD) + "]}", json.dumps(GOOD) + ',"x":{}', json.dumps(GOOD) + " tail", "[" + json.dumps(GOOD) + "]", "5", "null", '"x"', "{'user_id': 'u'}", "{}", json.dumps(GOOD | {"stars": [1], "text": {"a": "]"}}), "  " + json.dumps(GOOD) + "  ", json.dumps(dict.fromkeys(GOOD))]
WRONG = {3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13}


def test_rejects_in_batch_and_stream(spark, tmp_path):
    """The same reviews and the same rejects for the same dirty folder, batch by batch, and after a batch that came twice."""
    feed, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    feed.mkdir()
    parsed = stream_parsed(spark, str(feed), REVIEWS)
    assert [x.count() for x in L.split_results(parsed, REVIEWS, out)] == [0, 0]
    for i in range(2):
        arrive(feed, i, LINES)
        L.split_feed(parsed, REVIEWS, out, state, availableNow=True).awaitTermination()
        replay(state)
        L.split_feed(parsed, REVIEWS, out, state, availableNow=True).awaitTermination()
    good, bad = read_with_rejects(spark, str(feed), REVIEWS)
    assert sorted(x.line for x in bad.collect()) == sorted(2 * [LINES[i] for i in WRONG]) and {x.reason for x in bad.collect()} == {"not one JSON object"}
    assert good.count() == 2 * (len(LINES) - len(WRONG) - 2)
    live_good, live_bad = L.split_results(parsed, REVIEWS, out)
    assert sorted(map(repr, live_good.collect())) == sorted(map(repr, good.collect()))
    assert rows(live_bad) == rows(bad)
    assert {tuple(x) for x in L.split_counts(spark, out).select("batch", "reason", "lines").collect()} == {(b, r, n) for b in (0, 1) for r, n in (("", len(LINES) - len(WRONG) - 2), ("not one JSON object", len(WRONG)))}
    assert rows(L.drain(O.count_by(stream_reviews(spark, str(feed)).select(F.coalesce("user_id", F.lit("?")).alias("u")), "u"))) == rows(O.count_by(good.select(F.coalesce("user_id", F.lit("?")).alias("u")), "u"))


def test_business_rejects(spark, tmp_path):
    shop = {"business_id": "b", "city": "X", "state": None, "stars": "4.5", "latitude": "north", "hours": {"Monday": "9-5"}, "attributes": "none"}
    lines = [json.dumps(shop), "{", json.dumps(shop | {"business_id": None}), json.dumps(shop | {"business_id": ""}), json.dumps({"city": "Y"}), json.dumps(shop) + "{}", ""]
    (tmp_path / "b.json").write_text("\n".join(lines))
    good, bad = read_with_rejects(spark, str(tmp_path / "b.json"), BUSINESSES)
    assert sorted((x.line, x.reason) for x in bad.collect()) == sorted([(lines[1], "not one JSON object"), (lines[5], "not one JSON object"), *((lines[i], "no business_id") for i in (2, 3, 4))])
    (x,) = good.collect()
    assert (x.business_id, x.stars, x.latitude, x.hours, x.attributes) == ("b", 4.5, None, {"Monday": "9-5"}, None)
    assert rows(O.city_labels(read_businesses(spark, str(tmp_path / "b.json")))) == [("b", "X ()")]
    assert rows(O.city_labels(spark.createDataFrame([(None, None, None), ("b", None, None)], "business_id string, city string, state string"))) == [("b", " ()")]


@pytest.mark.parametrize("size", [None, "200b"])
def test_first_lines(spark, tmp_path, size):
    """What stands first, by file name and place, however files are cut into tasks; blank lines count."""
    r, lines = random.Random(3), []
    for i, n in enumerate([3, 0, 40, 1, 200, 7]):
        own = [f"{i}-{j} {'x' * r.randrange(60)}" if r.random() < 0.9 else "" for j in range(n)]
        (tmp_path / f"part {i}%.txt").write_text("".join(x + "\n" for x in own))
        lines += own
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    if size:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        for n in (1, 3, 4, 43, 44, 50, 243, 251, 400):
            assert sorted(x.value for x in first_lines(spark, str(tmp_path), n).collect()) == sorted(lines[:n])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    with pytest.raises(ValueError):
        first_lines(spark, str(tmp_path), 0)


def test_reports_in_parts(spark, tmp_path):
    """Parts put together by name are the report, also when a name holds what stands between names."""
    users = spark.range(5000).selectExpr("concat(if(id % 7 = 0, ' ; ', ''), cast(id % 2000 as string)) user_id", "5.0 stars", "'same' text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    for n in (1, 99):
        P.write_user_report(P.best_users(users, n).repartition(6), P.best_head(n), str(tmp_path / f"r{n}"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for n in (1, 99):
        parts = sorted(glob.glob(str(tmp_path / f"r{n}/part-*")))
        assert "".join(open(p, newline="").read() for p in parts) == P.report_best_users(users, n).first()[0]
        assert n == 99 or len([p for p in parts if os.path.getsize(p)]) > 1


def test_dimension(spark):
    reviews = spark.createDataFrame([(f"b{i % 9}", i % 3) for i in range(90)] + [(None, 1), ("nowhere", 2)], "business_id string, funny long")
    shops = spark.createDataFrame([(x["business_id"], x["city"], x["state"]) for x in SHOPS + SHOPS[:3]] + [(None, None, None)], "business_id string, city string, state string")
    kind = lambda df: df._jdf.queryExecution().executedPlan().toString()
    by_broadcast, by_rows, by_size = O.funny_by_city(reviews, shops), O.funny_by_city(reviews, shops, 5), O.funny_by_city(reviews, shops, 100, 20)
    assert "BroadcastHashJoin" in kind(by_broadcast) and "SortMergeJoin" in kind(by_rows) and "SortMergeJoin" in kind(by_size)
    assert rows(by_broadcast) == rows(by_rows) == rows(by_size) and sum(x[1] for x in rows(by_rows)) == 60


def test_nothing_is_kept(spark):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    shops = spark.createDataFrame([("b1", "X", "Y")], "business_id string, city string, state string")
    reviews = spark.createDataFrame([("u", "b1", 5.0, 1, None, "t")], "user_id string, business_id string, stars double, funny long, review_date date, text string")
    assert P.all_flows(reviews, shops, 1, 1).count() == 11
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
