"""Tables written to the folder that all executors share, to cut lineage.

A table there survives the loss of executors and is computed once however often it is read. It is deleted by `free`, at the
end of the `scoped` block it was written in, or when the Python process ends."""
from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}
#: Paths written in each open scope, innermost last.
_scopes: list[list[str]] = []


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder on whatever file system it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _remove_at_exit(spark: SparkSession, root: str) -> None:
    try:
        remove(spark, root)
    except Exception:  # noqa: BLE001  the session is gone, and nothing is left to delete with
        pass


def scratch_dir(spark: SparkSession) -> str:
    """A folder of this application's own in spark.checkpoint.dir; where that is unset (tests), in a local temporary folder."""
    application = spark.sparkContext.applicationId
    if application not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="opinaria-")
            spark.conf.set("spark.checkpoint.dir", base)
        _roots[application] = f"{base.rstrip('/')}/opinaria-{uuid.uuid4().hex}"
        atexit.register(_remove_at_exit, spark, _roots[application])
    return _roots[application]


def cut(df: DataFrame, name: str, *partition_by: str, buckets: tuple[int, str] | None = None) -> DataFrame:
    """Writes `df` to the shared folder and reads it again. With `buckets`, (number, column), what is grouped or joined by that
    column is read where it lies, without a shuffle."""
    spark, path = df.sparkSession, f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    if _scopes:
        _scopes[-1].append(path)
    if buckets:
        table = f"scratch_{uuid.uuid4().hex}"  # only tables have buckets; this one is forgotten at once, its files stay
        df.write.format("parquet").bucketBy(*buckets).option("path", path).saveAsTable(table)
        out = spark.table(table)
        spark.sql(f"drop table {table}")
    else:
        df.write.partitionBy(*partition_by).parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def free(*tables: DataFrame) -> None:
    """Deletes tables that `cut` returned, once all that was made of them is written."""
    for df in tables:
        path = getattr(df, "_scratch_path", None)
        if path:
            remove(df.sparkSession, path)


@contextmanager
def scoped(spark: SparkSession) -> Iterator[None]:
    """Tables cut inside the block are deleted at its end: write what is to be kept elsewhere before."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove(spark, path)
