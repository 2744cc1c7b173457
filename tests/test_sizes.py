"""What a task holds doesn't grow with the tables: pieces of a size, a scan and a parse for each line."""
import glob
import json

import pytest
from pyspark.sql import functions as F

from opinaria import plans as P, streaming as L
from opinaria.plans import catalog, testviews as V
from opinaria.sources import REVIEWS, KeyedTable, parse, read_reviews, read_tagged, stream_parsed, stream_reviews
from opinaria.sources.sizes import READS
from tests.oracle import same
from tests.test_feedback import review, rows
from tests.test_stored import LINES, USERS, named

SF = "/root/testdata/sf0.001"
PIECE, FILE = "opinaria.sources.sizes.PIECE", "opinaria.plans.testviews.LINES"


@pytest.fixture
def small(monkeypatch):
    """Sizes so small that small tables are cut, too, and no lines that were written with others."""
    monkeypatch.setattr(PIECE, 500)
    monkeypatch.setattr(FILE, 500)
    monkeypatch.setattr(V, "_folders", {})


@pytest.mark.parametrize("merge", [None, {"reviews": "sum"}])
def test_a_bucket_is_rewritten_in_pieces(spark, tmp_path, monkeypatch, merge):
    monkeypatch.setattr(PIECE, 50)
    t = KeyedTable(spark, str(tmp_path / "t"), USERS, ["user_id"], 2, merge)
    users = lambda a, b: named(spark, (None, 1), *((f"u{i}", i) for i in range(a, b)))
    t.apply(users(0, 900), 0, "w")
    t.apply(users(600, 1000), 1, "w")
    want = {f"u{i}": i * (2 if merge and 600 <= i < 900 else 1) for i in range(1000)} | {None: 2 if merge else 1}
    assert {x.user_id: x.reviews for x in t.read().collect()} == want and t.read().count() == 1001
    files = glob.glob(str(tmp_path / "t/rows/version=1/bucket=*/*.parquet"))
    assert len(files) > 10 and max(spark.read.parquet(f).count() for f in files) < 300


def test_state_is_dealt_out_by_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(PIECE, 10)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/0.json").write_text("\n".join(json.dumps(review(f"u{i % 40}", i, "t")) for i in range(90)))
    plan, before = P.best_users(stream_reviews(spark, str(tmp_path / "in")), 2), spark.conf.get("spark.sql.shuffle.partitions")
    L.start(plan, str(tmp_path / "out"), str(tmp_path / "state"), rows=90, availableNow=True).awaitTermination()
    assert len(glob.glob(str(tmp_path / "state/state/0/*/1.zip"))) == 9  # on disk, a file for each partition
    assert spark.conf.get("spark.sql.shuffle.partitions") == before and spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")
    assert rows(L.newest(plan, str(tmp_path / "out"))) == rows(P.best_users(read_reviews(spark, str(tmp_path / "in")), 2))


def test_lines_are_written_in_files_of_a_size(spark, small):
    n = V.rows_of(spark, SF)
    for path in (V.ordered_lines(spark, SF), V.ordered_lines(spark, SF, 4), V.dirty_lines(spark, SF), V.review_lines(spark, SF)):
        sizes = [r[1] for r in spark.read.text(path).groupBy("_metadata.file_name").count().collect()]
        assert sum(sizes) == n and max(sizes) <= 1000
    parts = [spark.read.text(V.ordered_part(spark, SF, 4, i)) for i in range(4)]
    assert sum(p.count() for p in parts) == n and all(p.count() > n / 8 for p in parts)


@pytest.mark.parametrize("name", ["stream_update_user_counts", "ledger_flows", "stream_all_flows", "first_reviews", "stream_scan_rejects", "stream_scan_best_users", "stream_distinct_text_counts"])
def test_in_pieces_against_sql(spark, small, name):
    assert same(catalog.queries()[name](spark, SF), catalog.oracle_sql()[name], SF) > 0


def test_a_ledger_keeps_shares_not_reviews(spark, tmp_path, monkeypatch):
    kept, persist = [], type(spark.range(1)).persist
    monkeypatch.setattr(type(spark.range(1)), "persist", lambda df, *a: (kept.append(df.count()), persist(df, *a))[1])
    path = tmp_path / "r.json"
    path.write_text("\n".join(json.dumps(review(f"u{i % 5}", i, "t")) for i in range(500)))
    catalog.Ledger(spark, str(tmp_path / "ledger"), 2).absorb(read_reviews(spark, str(path)), 1)
    assert 0 < max(kept) < 100


def test_a_line_is_parsed_once(spark, tmp_path):
    (tmp_path / "l.json").write_text("\n".join(LINES))
    lines = spark.read.text(str(tmp_path / "l.json"))
    for df in (P.best_users(read_reviews(spark, str(tmp_path / "l.json")), 1), parse(lines, REVIEWS).where("reason is null").select("record.user_id")):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json(ArrayType") == 1


def test_rejects_and_records_from_one_scan(spark, tmp_path):
    (tmp_path / "l.json").write_text("\n".join(LINES))
    both = read_tagged(spark, str(tmp_path / "l.json"), REVIEWS)
    assert both.where("reason is null and line is null").count() == len(read_reviews(spark, str(tmp_path / "l.json")).collect())
    assert both.where("reason is not null and line is not null and user_id is null").count() == 11
    plan = catalog.queries()["scan_rejects"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [value") == 1 and plan.count("from_json(ArrayType") == 1


def test_a_split_feed_keeps_the_lines_of_rejects_only(spark, tmp_path, monkeypatch):
    kept, persist = [], type(spark.range(1)).persist
    (tmp_path / "in").mkdir()
    (tmp_path / "in/l.json").write_text("\n".join(LINES))
    monkeypatch.setattr(type(spark.range(1)), "persist", lambda df, *a: (kept.append(df.where("line is not null").count()), persist(df, *a))[1])
    L.split_feed(stream_parsed(spark, str(tmp_path / "in"), REVIEWS), REVIEWS, str(tmp_path / "out"), str(tmp_path / "state"), availableNow=True).awaitTermination()
    assert kept == [11]


@pytest.mark.parametrize("merge", [None, {"reviews": "sum"}])
def test_no_task_gets_two_pieces(spark, tmp_path, merge):
    t = KeyedTable(spark, str(tmp_path / "t"), USERS, ["user_id"], 4, merge)
    users = named(spark, *((f"u{i}", i) for i in range(2000))).withColumn("_gone", F.lit(False))
    merged = t._merged(users, users.drop("_gone").limit(0), 10)
    tasks = merged.groupBy(F.spark_partition_id().alias("task")).agg(F.countDistinct("_piece").alias("n")).collect()
    assert [x.n for x in tasks] == [1] * 40
    assert merged._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_a_task_reads_files_of_a_size(spark, tmp_path, monkeypatch):
    """Of a batch with many files, however many that are."""
    monkeypatch.setitem(READS, "spark.sql.files.maxPartitionBytes", "20000")
    (tmp_path / "in").mkdir()
    for i in range(40):
        (tmp_path / f"in/{i}.json").write_text("\n".join(json.dumps(review(f"u{j}", j, "t")) for j in range(100)))
    tasks, before = [], spark.conf.get("spark.sql.files.maxPartitionBytes")
    parts = stream_reviews(spark, str(tmp_path / "in")).select(F.spark_partition_id().alias("part"))
    assert L.drain(parts, "append", keys=["part"], merge={}, buckets=2).count() == 40
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
