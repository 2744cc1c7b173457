"""Helpers that several operators share."""
from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

#: A word: what stands between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes of a lookup table that may be broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 64 << 20


def whole(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def n_words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))


def columns(df: DataFrame) -> list[Column]:
    """All columns, whatever characters their names have."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def fresh(df: DataFrame, name: str) -> str:
    """A name that no column of df has."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, however often body and its lambdas read it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def numbers(xs: list[int]) -> Column:
    """A constant array; as one text it doesn't cost the driver a call for each number."""
    return F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """`df` marked for broadcast if it is found to have `rows` rows and `size` bytes of JSON at most; pass a table that is
    cheap to count."""
    found = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*columns(df))))), F.lit(0)).alias("size")).first()
    return F.broadcast(df) if found.rows <= rows and found.size <= size else df


def crc_split(key: str, modulus: int, held: int) -> Column:
    """True for rows held out: crc32 of the key as text leaves the remainder `held`. A null key is never held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % modulus == held, F.lit(False))


def tables(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterable[pa.RecordBatch], column: str, size: int = 1 << 21) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of batches with their texts (null: empty), about `size` bytes each, but whole rows and one at least. Only a
    part's texts are held at a time."""
    for batch in batches:
        start = held = 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
            if held and held + n > size:
                yield _texts(batch.slice(start, i - start), column)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield _texts(batch.slice(start), column)


def _texts(part: pa.RecordBatch, column: str) -> tuple[pa.RecordBatch, list[str]]:
    return part, [x or "" for x in part.column(column).to_pylist()]
