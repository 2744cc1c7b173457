"""A stored table with one row for each key, changed batch by batch, each batch once.

Rows lie in buckets by a hash of their key. A batch rewrites the buckets that its keys fall into, beside those it leaves, and
then commits: a list of which folder holds which bucket now, and of the last batch of each writer. A batch that a writer has
committed before is skipped, so a batch may be replayed after a failure at any point. Nobody reads what isn't committed; the
last `KEPT` states stay for those who still read them. A bucket is rewritten in pieces of about `PIECE` rows, each by a task and
into a file of its own, so a table may grow past what a task can hold.

There are two kinds. Without `merge`, a batch holds whole rows, which replace those of their keys, or delete them where
`deleted` says so. With `merge`, a batch holds shares, which are added to what there is: column by column `sum`, `min` or
`max`, so that shares may come in any order. One writer at a time changes a table."""
from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .scratch import remove
from .sizes import pieces

KEPT = 2


class _State(NamedTuple):
    version: int
    buckets: dict[int, int]  # the version that wrote each bucket
    writers: dict[str, int]  # the last batch of each


def _paths(spark: SparkSession, pattern: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return [f.getPath().toString() for f in found]


def numbered(spark: SparkSession, pattern: str) -> list[int]:
    """The numbers in names `name=number` or `name=number.json`, in order."""
    return sorted(int(p.rsplit("=", 1)[1].removesuffix(".json")) for p in _paths(spark, pattern))


def committed(spark: SparkSession, root: str, name: str) -> list[int]:
    """Numbers of the folders `name=number` under `root` that Spark has written whole."""
    return sorted(int(p.split("/")[-2].split("=")[1]) for p in _paths(spark, f"{root}/{name}=*/_SUCCESS"))


def combined(shares: DataFrame, keys: Sequence[str], how: Mapping[str, str]) -> DataFrame:
    """One row for each key."""
    if not how:
        return shares.select(*keys).distinct()
    return shares.groupBy(*keys).agg(*[F.expr(f"{f}(`{c}`)").alias(c) for c, f in how.items()])


class KeyedTable:
    """`buckets` must stay what it was when the table was begun."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], buckets: int = 16, merge: Mapping[str, str] | None = None):
        values = [f.name for f in schema if f.name not in keys]
        if merge is not None and (set(merge) != set(values) or not set(merge.values()) <= {"sum", "min", "max"}):
            raise ValueError(f"merge must say sum, min or max for each of {values}")
        self.spark, self.path, self.schema, self.keys, self.n, self.how = spark, path, schema, list(keys), buckets, merge
        self._known: dict[int, _State] = {}

    def _state(self, version: int) -> _State:
        if version not in self._known:
            text = self.spark.read.text(f"{self.path}/commits/version={version}.json", wholetext=True).first()[0]
            said = json.loads(text)
            if said["buckets"] != self.n:
                raise ValueError(f"{self.path} has {said['buckets']} buckets, not {self.n}")
            self._known[version] = _State(version, {int(b): v for b, v in said["rows"].items()}, said["writers"])
        return self._known[version]

    def _versions(self) -> list[int]:
        return numbered(self.spark, f"{self.path}/commits/version=*.json")

    def _newest(self) -> _State:
        found = self._versions()
        return self._state(found[-1]) if found else _State(-1, {}, {})

    def last(self, writer: str) -> int:
        """The last batch that a writer has committed; -1 before there is one."""
        return self._newest().writers.get(writer, -1)

    def read(self, writer: str | None = None, upto: int | None = None) -> DataFrame:
        """The rows as committed last, or with the last batch `upto` of a writer."""
        state = self._newest()
        if upto is not None:
            for version in reversed(self._versions()):
                state = self._state(version)
                if state.writers.get(writer, -1) <= upto:
                    break
            else:
                if state.version > 0:
                    raise LookupError(f"{self.path} no longer has the state of batch {upto}")
                state = _State(-1, {}, {})
        return self._rows(state, state.buckets)

    def _rows(self, state: _State, buckets) -> DataFrame:
        paths = [f"{self.path}/rows/version={state.buckets[b]}/bucket={b}" for b in sorted(buckets) if b in state.buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def apply(self, batch: DataFrame, number: int, writer: str, deleted: Column | None = None, kept_already: bool = False) -> bool:
        """Takes in a writer's batch, whose keys are distinct unless the table merges; False if it was committed before. The batch
        is read twice, and kept meanwhile unless the caller has kept it already."""
        state = self._newest()
        if number <= state.writers.get(writer, -1):
            return False
        version, names = state.version + 1, [f.name for f in self.schema]
        rows = batch.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema], (F.lit(False) if deleted is None else F.coalesce(deleted, F.lit(False))).alias("_gone"))
        rows = rows if kept_already else rows.persist()
        try:
            sizes = {r[0]: r[1] for r in rows.groupBy(self._hash(self.n).alias("b")).agg(F.count(F.lit(1))).collect()}  # buckets, at most
            changed = sorted(sizes)
            if changed:
                kept = self._rows(state, changed)
                each = pieces(-(-(sum(sizes.values()) + kept.count()) // len(changed)))
                merged = self._merged(rows, kept, each)
                merged = merged.select(*names, (F.col("_piece") % self.n).alias("bucket"))
                merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/version={version}")
        finally:
            if not kept_already:
                rows.unpersist()
        filled = set(numbered(self.spark, f"{self.path}/rows/version={version}/bucket=*")) if changed else set()
        buckets = {b: v for b, v in state.buckets.items() if b not in changed} | {b: version for b in filled}
        self._commit(_State(version, buckets, state.writers | {writer: number}))
        return True

    def _hash(self, n: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(n)).cast("int")

    def _merged(self, rows: DataFrame, kept: DataFrame, each: int) -> DataFrame:
        """Rows of the changed buckets, each cut into `each` pieces: piece p is a part of bucket p % n. One shuffle deals the
        pieces out, piece p to task p, so no task gets two, and a key's rows meet there."""
        by = [*self.keys, "_piece"]
        both = kept.withColumns({"_gone": F.lit(False), "_new": F.lit(False)}).unionByName(rows.withColumn("_new", F.lit(True)))
        both = both.withColumn("_piece", self._hash(self.n * each)).repartitionById(self.n * each, "_piece")
        if self.how is not None:
            return combined(both, by, self.how)
        values = [f.name for f in self.schema if f.name not in self.keys]
        last = both.groupBy(*by).agg(F.max_by(F.struct("_gone", *values), "_new").alias("_last"))  # a batch's row goes before a kept one
        return last.where("not _last._gone").select(*by, *[F.col("_last").getField(v).alias(v) for v in values])

    def _commit(self, state: _State) -> None:
        """The state's file is written beside its place and moved there, which is one step; it fails if another writer was
        faster."""
        said = json.dumps({"buckets": self.n, "rows": state.buckets, "writers": state.writers})
        new, place = (self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits/{name}") for name in (f"_new-{uuid.uuid4().hex}", f"version={state.version}.json"))
        fs = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = fs.create(new)
        out.write(bytearray(said.encode()))
        out.close()
        if fs.exists(place) or not fs.rename(new, place):
            raise RuntimeError(f"version {state.version} of {self.path} was committed by another writer")
        self._known[state.version] = state
        versions = self._versions()
        used = {v for version in versions[-KEPT:] for v in self._state(version).buckets.values()}
        for version in versions[:-KEPT]:
            remove(self.spark, f"{self.path}/commits/version={version}.json")
        for version in numbered(self.spark, f"{self.path}/rows/version=*"):
            if version not in used and version < state.version:
                remove(self.spark, f"{self.path}/rows/version={version}")
