"""How finely work is dealt out: by the rows there are, so that what a task holds doesn't grow with a table."""
from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Rows that a task sorts, groups or writes at once.
PIECE = 500_000
#: Bytes of files that a task reads at once. Spark's own 128 MB are millions of lines where files are compressed, and a task
#: that adds up by key sorts them all.
READ = 16 << 20


def pieces(rows: int) -> int:
    return max(1, -(-rows // PIECE))


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """The session has these settings inside the block: plans that are run, and streaming queries that are started there."""
    before = {name: spark.conf.get(name, None) for name in conf}
    for name, value in conf.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def shuffles(spark: SparkSession, rows: int) -> dict[str, str]:
    """Setting: a shuffle partition for each PIECE of the rows, and as many as the session has at least."""
    return {"spark.sql.shuffle.partitions": str(max(int(spark.conf.get("spark.sql.shuffle.partitions")), pieces(rows)))}


#: Setting: a task reads READ bytes, or one file that can't be split.
READS = {"spark.sql.files.maxPartitionBytes": str(READ)}
