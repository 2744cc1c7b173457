"""Sharding by histogram sort: shards of equal bytes, each a range of one sort key.

The key has 63 bits: 40 of a hash of the text, then 23 of a hash of the id, so equal texts stand together and a group of
copies larger than a shard can still be cut. Bytes and rows below candidate boundaries are counted exactly over all
partitions; intervals that are too heavy, or that hold a shard's border and aren't yet small enough, are probed again at
64 finer boundaries, until every border is met within the tolerance or its interval holds one key. Then rows move once,
to their interval, where a running count plus the counts below it is the slot. What comes to the driver is counts: at most
64 for each of some hundred intervals, however many rows there are. The last step has a task for each interval, so raise
`intervals` where a cluster has more cores than that.

An interval that is a single key and has more than `PIECE` rows holds rows that are equal in id and text. Those are counted
instead, where they stand, so only their number moves, and are told apart when slots are dealt, a piece of them in a task. A
border that falls among them is put after so many of them.

Defined cases. Null text: no bytes, size 1, crc32 of an empty text. Very long texts: only their size and hashes move. Ties:
equal rows (same id and text) take adjoining slots; of rows with equal keys, the order is by id as text, size and checksum.
Null ids: rows like others. Empty table: no rows. Columns are read by name, so others may have any name."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from opinaria.sources.scratch import cut

from .common import numbers, whole

SPACE, FANOUT, INTERVALS = 1 << 63, 64, 512
#: Equal rows that one step tells apart.
PIECE = 100_000


def sort_key(key: str, text: str) -> Column:
    high = F.shiftrightunsigned(F.xxhash64(whole(text)), 24)
    low = F.shiftrightunsigned(F.xxhash64(F.col(key).cast("string")), 41)
    return F.shiftleft(high, 23).bitwiseOR(low)


def interval(key: str, bounds: list[int]) -> Column:
    """How many of the sorted boundaries are at or below the key: a binary search. `bounds` is some thousand long."""
    top = 1 << max(1, len(bounds).bit_length())
    table = numbers(bounds + [SPACE - 1] * (top - len(bounds)))
    steps = F.array(*[F.lit(top >> i) for i in range(1, top.bit_length())])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.element_at(table, at + s) <= F.col(key), at + s).otherwise(at))


def histogram(rows: DataFrame, shards: int, tolerance: float, intervals: int = INTERVALS) -> list[tuple[int, int, int, bool]]:
    """rows: k, bytes, n. (lower bound, bytes, rows, whether it holds one key only) of intervals in key order. Counts are exact. Every interval that holds a shard's border has at most `tolerance` of a shard's bytes or one key only; the others have at most their share of all
    bytes or one key."""
    bounds = [SPACE // 4096 * i for i in range(4096)]
    while True:
        got = {r.i: (r.b, r.n) for r in rows.groupBy(interval("k", bounds).alias("i")).agg(F.sum("bytes").alias("b"), F.sum("n").alias("n")).collect()}
        total = sum(b for b, _ in got.values())
        heavy, allowed = max(1, total // intervals), max(1, int(tolerance * total / shards))
        merged: list[list[int]] = []  # [bound, bytes, rows, end]; light neighbours become one again
        below = 0
        borders = [total * s / shards for s in range(1, shards)]
        for j, lo in enumerate(bounds):
            end = bounds[j + 1] if j + 1 < len(bounds) else SPACE - 1
            b, n = got.get(j + 1, (0, 0))
            holds = any(below < x < below + b for x in borders)
            if merged and not holds and not merged[-1][4] and merged[-1][1] + b <= heavy // 2:
                merged[-1][1] += b
                merged[-1][2] += n
                merged[-1][3] = end
            else:
                merged.append([lo, b, n, end, holds])
            below += b
        again = [m for m in merged if m[3] - m[0] > 1 and (m[1] > heavy or m[4] and m[1] > allowed)]
        if not again:
            return [(lo, b, n, end - lo <= 1) for lo, b, n, end, _ in merged]
        bounds = []
        for m in merged:
            parts = min(FANOUT, m[3] - m[0]) if any(m is x for x in again) else 1
            bounds += [m[0] + (m[3] - m[0]) * p // parts for p in range(parts)]


def shard(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", tolerance: float = 0.001, intervals: int = INTERVALS) -> DataFrame:
    """(key, size, text_crc32, shard, slot) for all rows."""
    rows = docs.select(
        F.col(key).alias("id"), (F.octet_length(whole(text)) + 1).cast("long").alias("size"), F.crc32(whole(text)).alias("crc"), sort_key(key, text).alias("k"))
    rows = cut(rows, "shard-keys")
    found = histogram(rows.select("k", F.col("size").alias("bytes"), F.lit(1).alias("n")), shards, tolerance, intervals)
    total = sum(b for _, b, _, _ in found)
    home = lambda x: min(shards - 1, x * shards // max(1, total))
    below, seen, owner, first, pieces = 0, [0] * shards, [], [], []
    for j, (_, b, n, alone) in enumerate(found):
        owner.append(home(below + b // 2))
        first.append(seen[owner[-1]])
        if alone and home(below) < home(below + b - 1):
            # rows of one key that lie across a border: equal texts, so the border falls after so many of them
            reach = range(home(below), home(below + b - 1) + 1)
            starts = [0] + [min(n, max(0, round((s * total / shards - below) * n / b))) for s in reach[1:]]
            for s, lo, hi in zip(reach, starts, [*starts[1:], n]):
                pieces.append((j + 1, lo, s, seen[s] - lo))
                seen[s] += hi - lo
        else:
            seen[owner[-1]] += n
        below += b
    pick = lambda xs: F.element_at(numbers(xs), F.col("i"))
    order = W.partitionBy("i").orderBy("k", F.col("id").cast("string"), "size", "crc")
    rows = rows.withColumn("i", interval("k", [lo for lo, *_ in found]))
    many = [j + 1 for j, (_, _, n, alone) in enumerate(found) if alone and n > PIECE]
    if many:
        equal = rows.where(F.col("i").isin(many)).groupBy("i", "id", "size", "crc", "k").agg(F.count(F.lit(1)).alias("n"))
        equal = equal.withColumn("before", F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("n"))
        equal = equal.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {PIECE}"))).alias("piece")).repartition("i", "before", "piece")
        lo, hi = F.col("piece") * PIECE, F.least(F.col("n"), (F.col("piece") + 1) * PIECE) - 1
        equal = equal.select("i", "id", "size", "crc", "k", F.explode(F.sequence(F.col("before") + lo, F.col("before") + hi)).alias("row"))
        rows = rows.where(~F.col("i").isin(many))
    out = rows.withColumn("row", (F.row_number().over(order) - 1).cast("long"))
    if many:
        out = out.unionByName(equal)
    to, shift = pick(owner), pick(first)
    for i, lo, s, by in pieces:  # in order, so the last that applies holds
        here = (F.col("i") == i) & (F.col("row") >= lo)
        to, shift = F.when(here, s).otherwise(to), F.when(here, by).otherwise(shift)
    return out.select(F.col("id").alias(key), "size", F.col("crc").alias("text_crc32"), to.cast("int").alias("shard"), (shift + F.col("row")).cast("long").alias("slot"))


def query(spark, sf_dir: str) -> DataFrame:
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
