"""Near-duplicate embeddings by random-hyperplane signs.

1. sets: equal vectors of a label are one, with a count, so copies never meet.
2. codes: in each of several tables, the signs of fixed random projections. Vectors of one label with the same code meet
   in a bucket. The number of signs follows the number of vectors, so that unrelated ones seldom meet, and the number of
   tables follows from it: a pair at the least cosine misses all with a chance below 1e-5 (at 0.98, 11.5 degrees, it
   agrees in 14 signs with the chance 0.40, which takes 23 tables). Only numbers are dealt into tables; vectors are looked up
   for the members of shared buckets, last of all.
3. links: a bucket is compared block by block (`BLOCK` vectors against as many), cosine in double precision. A pair that
   shares several tables counts in the first. Out of a block come, for each vector, how many others it links to and one
   vector that it is connected with, so a group of near copies never turns into rows of pairs.
4. components of those edges.

Defined cases. Null label; vectors that are null, empty, zero, or hold a null or non-finite component: linked with
nothing. Vectors of different lengths aren't compared. Ties: a cosine of exactly the least is a link. Repeated rows are
vectors of their own, linked with each other; so are rows with a null id. A component is named by its smallest id; null ids
are never the smallest, and a component of null ids only has a null name. Empty table: no rows. Columns are read by name, so
others may have any name."""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from opinaria.sources.scratch import cut

from .components import components

MISSED, SEED, BLOCK = 1e-5, 7, 512


def planes(dim: int, tables: int, bits: int, seed: int = SEED) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([seed, dim])).standard_normal((dim, tables * bits))


def shape(n: int, least: float) -> tuple[int, int]:
    """Tables and signs for n vectors."""
    bits = min(60, max(14, n.bit_length()))
    agree = (1 - math.acos(min(1.0, least)) / math.pi) ** bits
    return (1 if agree == 1 else math.ceil(math.log(MISSED) / math.log(1 - agree))), bits


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, so that no square overflows on the way."""
    v = v.astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def codes(vectors: DataFrame, tables: int, bits: int) -> DataFrame:
    """(sid, label, n, v array<double or float>) -> (sid, label, n, dim, v as bytes, codes array<long>)."""
    single = vectors.schema["v"].dataType.elementType.simpleString() == "float"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, np.ndarray] = {}
        powers = np.int64(1) << np.arange(bits)
        for x in batches:
            raw = [np.array(v.values, np.float32 if single else np.float64) for v in x.column(3)]
            dims = [len(r) for r in raw]
            made = [None] * len(raw)
            for d in set(dims):
                if d not in drawn:
                    drawn[d] = planes(d, tables, bits)
                at = [i for i, k in enumerate(dims) if k == d]
                signs = unit(np.stack([raw[i] for i in at])) @ drawn[d] > 0
                for i, c in zip(at, signs.reshape(len(at), tables, bits) @ powers):
                    made[i] = c
            yield pa.RecordBatch.from_arrays([*x.columns[:3], pa.array(dims, pa.int32()), pa.array([r.tobytes() for r in raw], pa.binary()), pa.array(made, pa.list_(pa.int64()))], names=["sid", "label", "n", "dim", "v", "codes"])

    kind = vectors.schema["label"].dataType.simpleString()
    return vectors.select("sid", "label", "n", "v").mapInArrow(run, f"sid long, label {kind}, n long, dim int, v binary, codes array<long>")


def _connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A label for each of n nodes: the least node connected with it."""
    name = np.arange(n)
    while True:
        least = np.minimum(name[a], name[b])
        new = name.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == name).all():
            return name
        name = new


def links(coded: DataFrame, least: float, single: bool = False) -> DataFrame:
    """(sid, links, near): vectors linked to and one connected with, as each pair of blocks found them. `single`: vectors
    were given in single precision."""
    places = coded.select("sid", F.col("label").cast("string").alias("label"), "dim", F.posexplode("codes").alias("at", "code"))
    places = places.select("sid", "at", F.xxhash64("label", "dim", "at", "code").alias("bucket"))
    sizes = places.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    rows = places.join(cut(sizes, "cosine-buckets"), "bucket").withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    cols = ["bucket", "at", "sid"]
    left = rows.select(*cols, F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"), F.lit(True).alias("first"))
    right = rows.where("own > 0").select(*cols, F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("i"), F.col("own").alias("j"), F.lit(False).alias("first"))
    # the codes of the tables before, to tell whether a pair has met there, as bytes
    short = F.unhex(F.array_join(F.transform("codes", lambda c: F.lpad(F.hex(c), 16, "0")), ""))

    def compare(inside: bool, at: int, rows: list[tuple]) -> pa.RecordBatch | None:
        """rows: (first, sid, n, vector, codes) of two blocks, or of one with itself."""
        x = [r for r in rows if r[0]]
        y = x if inside else [r for r in rows if not r[0]]
        if not x or not y or len(x) + len(y) == 2 and inside:
            return None
        stack = lambda d: unit(np.frombuffer(b"".join(r[3] for r in d), np.float32 if single else np.float64).reshape(len(d), -1))
        yes = stack(x) @ stack(y).T >= least
        if inside:
            yes = np.triu(yes, 1)
        a, b = np.nonzero(yes)
        if at and len(a):
            cx, cy = (np.frombuffer(b"".join(r[4] for r in d), ">i8").reshape(len(d), -1)[:, :at] for d in (x, y))
            earlier = (cx[a] == cy[b]).any(1)
            a, b = a[~earlier], b[~earlier]
        if not len(a):
            return None
        ids = np.array([r[1] for r in x] + ([] if inside else [r[1] for r in y]), np.int64)
        nx, ny, shift = np.array([r[2] for r in x]), np.array([r[2] for r in y]), 0 if inside else len(x)
        total = np.bincount(a, ny[b], len(ids)) + np.bincount(b + shift, nx[a], len(ids))
        name = _connected(len(ids), a, b + shift)
        keep = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(total[keep].astype(np.int64)), pa.array(ids[name[keep]])], names=["sid", "links", "near"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if r[:4] != key:
                    if held and (out := compare(key[1] == key[2], key[3], held)) is not None:
                        yield out
                    key, held = r[:4], []
                held.append(r[4:])
        if held and (out := compare(key[1] == key[2], key[3], held)) is not None:
            yield out

    # two blocks' rows, a thousand or so, stand on end
    both = left.unionByName(right).join(coded.select("sid", "n", "v", short.alias("codes")), "sid").select("bucket", "i", "j", "at", "first", "sid", "n", "v", "codes")
    return both.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(run, "sid long, links long, near long")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.98) -> DataFrame:
    """(id, n_links, component_id) for every row of vectors."""
    single = vectors.schema[vector].dataType.elementType.simpleString() == "float"
    v = F.col(vector).cast(f"array<{'float' if single else 'double'}>")
    fine = F.col(label).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.when(F.coalesce(fine, F.lit(False)), v).alias("v"))
    rows = rows.withColumn("set_id", F.when(F.col("v").isNotNull(), F.unhex(F.md5(F.to_json(F.struct(F.col("label").alias("l"), "v"))))))
    sets = rows.where("set_id is not null").groupBy("set_id").agg(F.first("label").alias("label"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"), F.min("id").alias("least"))
    # numbered as written, so that what is dealt into buckets is short
    sets = cut(sets.withColumn("sid", F.monotonically_increasing_id()), "cosine-sets")
    coded = cut(codes(sets, *shape(sets.count(), least)), "cosine-codes")
    found = cut(links(coded, least, single), "cosine-links")
    names = components(found.select(F.col("sid").alias("a"), F.col("near").alias("b")))
    total = found.groupBy("sid").agg(F.sum("links").alias("links"))
    of = sets.select("sid", "set_id", "n", "least").join(names.withColumnRenamed("id", "sid"), "sid", "left").join(total, "sid", "left")
    of = cut(of.select("set_id", "least", F.coalesce("component", "sid").alias("component"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "cosine-of")
    name = cut(of.groupBy("component").agg(F.min("least").alias("component_id")), "cosine-names")
    of = cut(of.join(name, "component").select("set_id", "n_links", "component_id"), "cosine-result")
    out = rows.select("id", "set_id").join(of, "set_id", "left")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("set_id").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


#: All pairs of a label, in double precision; components by following links from each vector.
SQL = """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) e from embeddings
  where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
u as (select vec_id, label, len(e) dim, e, sqrt(list_dot_product(e, e)) size from v),
l as (select a.vec_id a, b.vec_id b from u a join u b on a.label = b.label and a.dim = b.dim and a.vec_id <> b.vec_id where list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.98),
r as (select a, b from l union select r.a, l.b from r join l on r.b = l.a),
n as (select a, count(*) n_links from l group by a),
c as (select a, least(a, min(b)) component_id from r group by a)
select vec_id, coalesce(n_links, 0) n_links, coalesce(component_id, vec_id) component_id, coalesce(component_id, vec_id) = vec_id kept
from embeddings left join n on n.a = vec_id left join c on c.a = vec_id
"""
