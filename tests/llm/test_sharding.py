import random
import zlib

import pytest
from pyspark.sql import functions as F

from opinaria.llm import sharding as S

CASES = {
    "plain": [(i, f"text {i} " * (i % 13)) for i in range(3000)],
    "third": [(i, "the same text" if i % 3 else f"own {i}") for i in range(3000)],
    "edges": [(1, None), (2, ""), (None, "x"), (None, "x"), (3, "y" * 100_000), (3, "z"), (3, "z")],
    "equal": [(7, "the same row") if i % 3 else (i, f"own {i}") for i in range(3000)],
    "empty": [],
    "one": [(1, "a")],
}


@pytest.mark.parametrize("name, piece", [*((name, S.PIECE) for name in CASES), ("equal", 7), ("edges", 1)])
def test_laws(spark, name, piece, monkeypatch):
    monkeypatch.setattr(S, "PIECE", piece)
    rows = CASES[name]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as size", "2 as shard", "3 as _k0", "4 as id", "5 as k", "6 as n")
    got = S.shard(df).collect()
    assert sorted((r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted((i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    total = [0] * 8
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
        total[s] = sum(r.size for r in got if r.shard == s)
    if len(rows) > 1000:
        largest = max(r.size for r in got)
        assert max(total) - min(total) <= 2 * (0.001 * sum(total) / 8 + largest)
    again = S.shard(df.repartition(5)).collect()
    key = lambda r: (r.doc_id or 0, r.size, r.text_crc32, r.shard, r.slot)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_very_many_equal_rows(spark):
    """Told apart piece by piece: no array or task holds them all."""
    n = 3_000_000
    df = spark.range(n).selectExpr("7L doc_id", "'same' text").union(spark.range(1000).selectExpr("id + 10", "cast(id as string)"))
    got = S.shard(df).groupBy("shard").agg(F.count("slot").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("last")).collect()
    assert sum(r.n for r in got) == n + 1000 and all(r.n == r.d == r.last + 1 for r in got) and len(got) == 8
