"""Runs the same plans on streams."""
from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import operators as O
from ..sources.keyed import KeyedTable, combined, committed
from ..sources.readers import Feed, records, rejects
from ..sources.scratch import remove, scratch_dir
from ..sources.sizes import READS, settings, shuffles
from .flows import Flows, consume, flow_counts

__all__ = ["Flows", "distinct_counts", "drain", "flow_counts", "newest", "run", "split_feed", "start"]


#: State lies on disk, with a bounded part of it in memory, whatever the number of users.
ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}


def run(df: DataFrame, sink: Callable[[DataFrame, int], None], state: str, mode: str = "append", rows: int = 0, **trigger) -> StreamingQuery:
    """Hands each batch and its number to `sink`. `state` keeps the query's progress, from which it resumes after a failure;
    the batch that was under way then comes again, with the same number. The state is dealt out when the query starts for the
    first time and stays so: `rows` says how many rows it is to hold in the end, if that is more than the session's shuffle
    partitions are meant for.

    A file source deals a batch out by the settings that the session has when the batch runs, so `sizes.READS`, which bounds what
    a task reads of it, is for the caller to keep until the query ends."""
    with settings(df.sparkSession, ON_DISK | shuffles(df.sparkSession, rows)):  # the query starts with a copy of the session
        return df.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(**(trigger or {"processingTime": "10 seconds"})).foreachBatch(sink).start()


def start(df: DataFrame, out: str, state: str, mode: str = "complete", keys: Sequence[str] = (), buckets: int = 16, merge: Mapping[str, str] | None = None, rows: int = 0, **trigger) -> StreamingQuery:
    """Keeps the result of a streaming query under `out`, where `newest` finds it.

    complete: each whole result gets a folder of its own; the one before is kept for those who still read it.
    update: the rows that a batch changed replace those of their `keys` in a KeyedTable, so a batch costs the buckets it touches.
    append: new rows are shares, which `merge` adds to those of their `keys` (sum, min or max).
    A batch that comes again after a failure is taken in once."""
    if mode == "complete":
        def sink(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
            for old in committed(batch.sparkSession, out, "batch")[:-2]:
                remove(batch.sparkSession, f"{out}/batch={old}")
    else:
        if not keys or (mode == "append") != (merge is not None):
            raise ValueError(f"mode {mode!r} writes a part of the result at a time: it needs keys, and append needs merge")
        table = KeyedTable(df.sparkSession, out, df.schema, keys, buckets, merge)

        def sink(batch: DataFrame, number: int) -> None:
            if not table.apply(batch if merge is None else combined(batch, keys, merge), number, state):
                consume(batch)

    return run(df, sink, state, mode, rows, **trigger)


def newest(df: DataFrame, out: str, keys: Sequence[str] = (), buckets: int = 16, merge: Mapping[str, str] | None = None) -> DataFrame:
    """The newest whole result of a query that `start` runs for the plan `df`; no rows before there is one."""
    spark = df.sparkSession
    if keys:
        return KeyedTable(spark, out, df.schema, keys, buckets, merge).read()
    numbers = committed(spark, out, "batch")
    return spark.read.schema(df.schema).parquet(f"{out}/batch={numbers[-1]}") if numbers else spark.createDataFrame([], df.schema)


def drain(df: DataFrame, mode: str = "complete", rows: int = 0, **how) -> DataFrame:
    """Takes in what is there, stops, and returns the result; a batch DataFrame passes through. An input without files gives
    what the plan gives without rows, as no batch runs: no rows. mode, rows, keys, buckets and merge as in `start`."""
    if not df.isStreaming:
        return df
    where = _own_folder(df.sparkSession)
    with settings(df.sparkSession, READS):
        start(df, f"{where}/out", f"{where}/state", mode, rows=rows, **how, availableNow=True).awaitTermination()
    return newest(df, f"{where}/out", **how)


def _own_folder(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"


def distinct_counts(reviews: DataFrame, out: str, state: str, key: str = "user_id", text: str = "text", name: str = "distinct", buckets: int = 16, **trigger) -> StreamingQuery:
    """Exact numbers of distinct texts of each key on a stream, as `operators.distinct_count` has them; `counted` reads them.

    Two states in a row: the query's own keeps each distinct (key, digest) once and passes on those that are new; the table
    adds them up by key. The first grows with the distinct pairs, a key and 32 characters each, however often a text is
    repeated; pairs are spread over all tasks, so a key with a third of all texts is no hot one. The second has a row for
    each key. Nothing is forgotten, as a text may come back at any time."""
    pairs = O.distinct_pairs(reviews, key, text).select(key, F.lit(1).cast("long").alias(name))
    return start(pairs, out, state, "append", [key], buckets, {name: "sum"}, **trigger)


def counted(reviews: DataFrame, out: str, key: str = "user_id", name: str = "distinct", buckets: int = 16) -> DataFrame:
    return newest(reviews.select(key, F.lit(1).cast("long").alias(name)), out, [key], buckets, {name: "sum"})


def split_feed(parsed: DataFrame, feed: Feed, out: str, state: str, **trigger) -> StreamingQuery:
    """Writes a stream of parsed lines (`sources.stream_parsed`) to `out`/records and `out`/rejects, a folder for each batch; a
    batch that comes again overwrites its own. Each batch is parsed once. `split_results` reads both, `split_counts` says how
    many rows of each kind every batch had."""
    def sink(batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("line", F.when(F.col("reason").isNotNull(), F.col("line"))).persist()  # a record's line isn't written
        try:
            counts = batch.groupBy(F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count(F.lit(1)).alias("lines"))
            for name, rows in (("records", records(batch, feed)), ("rejects", rejects(batch)), ("counts", counts)):
                rows.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        finally:
            batch.unpersist()

    return run(parsed, sink, state, **trigger)


def split_results(parsed: DataFrame, feed: Feed, out: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of the batches whose counts are written, as those are written last."""
    spark = parsed.sparkSession
    numbers = committed(spark, f"{out}/counts", "batch")

    def read(name: str, like: DataFrame) -> DataFrame:
        paths = [f"{out}/{name}/batch={n}" for n in numbers]
        return spark.read.schema(like.schema).parquet(*paths) if paths else spark.createDataFrame([], like.schema)

    return read("records", records(parsed, feed)), read("rejects", rejects(parsed))


def split_counts(spark: SparkSession, out: str) -> DataFrame:
    """(batch, reason, lines); an empty reason stands for records."""
    return spark.read.schema("reason string, lines long, batch long").parquet(f"{out}/counts")
