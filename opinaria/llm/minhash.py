"""Near-duplicate documents by circulant MinHash.

1. signatures: one fixed permutation spreads the shingles over 2^32 places; a second one, circularly shifted by
   0, 1, 2..., gives every coordinate of the signature (C-MinHash, Li and Li, 2022). `rows` coordinates make a band.
2. sets: documents with the same words are one set, whose members never meet each other again.
3. pivots: sets that share a band meet in its bucket. In each of `rounds` rounds the members of a bucket are compared
   with one of them, unless the two are known to be connected, and what is confirmed is joined into components. That
   settles most of a group of near copies with a pair for each member.
4. rest: members of a bucket that are in different components after that are all compared, block by block: those outside
   the bucket's largest component with every member of another component. Signatures are compared first, and texts are
   looked up for members whose signature agrees with another's. Only links that join components come out of a block, so a
   group never turns into rows of pairs, yet no pair that shares a band goes unchecked unless its two members are known to
   be connected.
5. Links are confirmed by the exact Jaccard of the whole shingle sets, as strings, for pairs whose signatures agree well
   enough.

A pair at the least similarity s = 0.8 shares no band with the chance (1 - s^rows)^bands = 7e-6 for 30 bands of 5, and
agrees in less than 65 % of 150 coordinates with the chance 1e-5.

Defined cases. Very long texts are read whole. Empty table: no rows. Ties: a similarity of exactly the least is a link, and a
bucket's pivot is the member with the least hash. Null text, or one without words: no shingles, linked with nothing, its own component. Fewer words than a
shingle: the whole sequence is the one shingle. A component is named by its smallest id; null ids are never the smallest,
and a component of null ids only has a null name. Repeated rows share a set and a component. Only ASCII letters are
lowered. Columns other than the two named are never read."""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from opinaria.sources.scratch import cut, free

from .common import slices, whole
from .components import components

BANDS, ROWS, ROUNDS = 30, 5, 1
#: Least share of equal coordinates of a pair that is worth reading, below the least similarity by five deviations.
SLACK = 0.15
BLOCK = 512


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, with A-Z lowered."""
    return text.encode().lower().split()


def shingle_set(words: list[bytes], n: int) -> set[bytes]:
    """Distinct shingles as joined words, which white space can't be part of."""
    if len(words) <= n:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[i:] for i in range(n)))))


def _mix32(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def shingle_hashes(words: list[bytes], n: int, memo: dict[bytes, int]) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles."""
    ids = np.array([memo[w] if w in memo else memo.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in words], np.uint64)
    m = max(1, len(ids) - n + 1)
    h = np.full(m, len(ids) if len(ids) < n else n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(min(n, len(ids))):
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + m]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(h ^ (h >> np.uint64(32)))


def sign(sets: list[np.ndarray], bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each non-empty set: a row of band hashes, and its coordinates' low 16 bits."""
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out, coordinates = np.zeros((len(sets), bands), np.uint64), np.zeros((len(sets), bands * rows), np.uint16)
    with np.errstate(over="ignore"):
        for k in range(bands * rows):
            least = np.minimum.reduceat(_mix32(flat + np.uint32(k)), starts)
            coordinates[:, k] = least & np.uint32(0xFFFF)
            b = out[:, k // rows]
            b[:] = (b ^ (b >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + least + np.uint64(1)
    return out.view(np.int64), coordinates


def signatures(docs: DataFrame, key: str, text: str, shingle: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, uid, n_shingles, set_id, bands, coordinates): set_id is the md5 of the words, null without words."""
    light = docs.select(F.col(key).alias("id"), F.xxhash64(F.col(key).cast("string"), whole(text)).alias("uid"), F.col(text).cast("string").alias("t"))
    more = [T.StructField("n_shingles", T.LongType()), T.StructField("set_id", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("coordinates", T.BinaryType())]
    out = T.StructType([*light.schema.fields[:2], *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "t"):
            memo: dict[bytes, int] = {}
            n, ids, sets = [], [], []
            for t in texts:
                w = words_of(t)
                ids.append(hashlib.md5(b" ".join(w)).digest() if w else None)
                if w:
                    sets.append(shingle_hashes(w, shingle, memo))
                n.append(len(sets[-1]) if w else 0)
            made, kept = sign(sets, bands, rows) if sets else ((), ())
            at = iter(range(len(sets)))
            at = [next(at) if i else None for i in ids]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(ids, pa.binary()),
                 pa.array([None if i is None else made[i] for i in at], pa.list_(pa.int64())), pa.array([None if i is None else kept[i].tobytes() for i in at], pa.binary())], names=out.names)

    return light.mapInArrow(run, out)


def _sizes_allow(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def confirm(pairs: DataFrame, sets: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) of set ids with 100 * intersection >= percent * union. sets: (set_id, coordinates, ...);
    texts: (set_id, t). Texts are read for pairs whose signatures agree well enough."""
    side = lambda df, at, *cols: df.select(F.col("set_id").alias(at), *(F.col(c).alias(f"{c}_{at}") for c in cols))
    least = percent / 100 - SLACK

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            u, v = (np.frombuffer(b"".join(x.column(i).to_pylist()), np.uint16).reshape(x.num_rows, -1) for i in (2, 3))
            yield x.select([0, 1]).filter(pa.array((u == v).mean(1) >= least)) if x.num_rows else x.select([0, 1])

    def equal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[str, set[bytes]] = ("", set())
        for x in batches:
            yes = []
            for ta, tb in zip(x.column(2), x.column(3)):
                ta = ta.as_py()
                if ta != known[0]:
                    known = (ta, shingle_set(words_of(ta), shingle))
                p, q = known[1], shingle_set(words_of(tb.as_py()), shingle)
                common = len(p & q)
                yes.append(100 * common >= percent * (len(p) + len(q) - common))
            yield x.select([0, 1]).filter(pa.array(yes, pa.bool_()))

    signed = pairs.join(side(sets, "a", "coordinates"), "a").join(side(sets, "b", "coordinates"), "b").select("a", "b", "coordinates_a", "coordinates_b")
    likely = cut(signed.mapInArrow(near, "a long, b long"), "minhash-likely")
    return likely.join(side(texts, "a", "t"), "a").join(side(texts, "b", "t"), "b").select("a", "b", "t_a", "t_b").mapInArrow(equal, "a long, b long")


def likely_in_block(at: int, left: list[tuple], right: list[tuple], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For rows (set_id, n, component, coordinates, bands) of two blocks of a bucket of band `at`: each left row that has
    any, with the right rows that it may be linked with, likeliest first. Pairs that share an earlier band meet there; pairs of
    one component are connected."""
    coordinates = np.frombuffer(b"".join(r[3] for r in right), np.uint16).reshape(len(right), -1)
    n, bands = np.array([r[1] for r in right]), np.array([r[4] for r in right], np.int64)
    number = {c: i for i, c in enumerate(dict.fromkeys(r[2] for r in right))}
    component = np.array([number[r[2]] for r in right])
    for i, (_, size, own, mine, bx, *_) in enumerate(left):
        ok = np.flatnonzero((100 * np.minimum(n, size) >= percent * np.maximum(n, size)) & (component != number.get(own, -1)))
        alike = (coordinates[ok] == np.frombuffer(mine, np.uint16)).mean(1)
        fine = (alike >= percent / 100 - SLACK) & ~(bands[ok, :at] == np.array(bx[:at], np.int64)).any(1)
        if fine.any():
            yield i, ok[fine][np.argsort(-alike[fine], kind="stable")]


def links_in_block(at: int, left: list[tuple], right: list[tuple], shingle: int, percent: int) -> list[tuple[int, int]]:
    """Links that join components, among rows (set_id, n, component, coordinates, bands, text) of two blocks of a bucket of
    band `at`. Pairs that are connected by now are passed over."""
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while c in parent:
            c = parent[c]
        return c

    sets: list[set[bytes] | None] = [None] * len(right)
    out = []
    for k, found in likely_in_block(at, left, right, percent):
        x, component, p = left[k][0], left[k][2], None
        for i in found.tolist():
            if root(component) == root(right[i][2]):
                continue
            p = shingle_set(words_of(left[k][5]), shingle) if p is None else p
            q = sets[i]
            if q is None:
                q = sets[i] = shingle_set(words_of(right[i][5]), shingle)
            common = len(p & q)
            if 100 * common >= percent * (len(p) + len(q) - common):
                out.append((x, right[i][0]))
                parent[root(component)] = root(right[i][2])
    return out


def by_block(rows: DataFrame, compare: Callable[[tuple, list[tuple], list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """rows (bucket, i, j, at, left, ...), dealt by pair of blocks. `compare` gets (bucket, i, j, at) and the other columns of
    the left and of the right rows, some thousand at most, and gives rows of the schema."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, ([], [])

        def done() -> Iterator[pa.RecordBatch]:
            found = compare(key, *held) if held[0] and held[1] else []
            if found:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*found)))), schema=kinds)

        for x in batches:
            for r in zip(*(c.to_pylist() for c in x.columns)):
                if r[:4] != key:
                    yield from done()
                    key, held = r[:4], ([], [])
                held[not r[4]].append(r[5:])
        yield from done()

    arrow = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    kinds = pa.schema([(name, arrow[kind]) for name, kind in (f.split() for f in schema.split(", "))])
    names = kinds.names
    return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(run, schema)


def rest_of_buckets(members: DataFrame, sets: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) among members (bucket, at, set_id, n, component) of open buckets that join their components."""
    sizes = members.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("c"))
    sizes = sizes.groupBy("bucket").agg(F.sum("c").alias("all"), F.max(F.struct("c", "component")).alias("largest"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    sizes = cut(sizes.select("bucket", F.col("largest.component").alias("largest"), blocks(F.col("all") - F.col("largest.c")).alias("lefts"), blocks(F.col("all")).alias("rights")), "minhash-rest-sizes")
    # few outside a large component make few blocks, each of which all members meet once
    rows = members.join(sizes, "bucket").withColumn("h", F.xxhash64("set_id"))
    own, each = lambda n: F.pmod("h", F.col(n)).cast("int"), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ["bucket", "at", "set_id", "n", "component"]
    left = rows.where("component <> largest").select(*cols, own("lefts").alias("i"), each("rights").alias("j"), F.lit(True).alias("left"))
    right = rows.select(*cols, each("lefts").alias("i"), own("rights").alias("j"), F.lit(False).alias("left"))
    order = ["bucket", "i", "j", "at", "left", "set_id", "n", "component"]
    marks = sets.select("set_id", "coordinates", "bands")
    signed = left.unionByName(right).join(marks, "set_id").select(*order, "coordinates", "bands")

    def likely(key: tuple, left: list[tuple], right: list[tuple]) -> list[tuple]:
        found = list(likely_in_block(key[3], left, right, percent))
        again = sorted({i for _, at in found for i in at.tolist()})
        of = [(True, left[k]) for k, _ in found] + [(False, right[i]) for i in again]
        return [(*key, side, *r[:3]) for side, r in of]

    alike = cut(by_block(signed, likely, "bucket long, i int, j int, at int, left boolean, set_id long, n long, component long"), "minhash-alike")
    told = alike.join(marks, "set_id").join(texts, "set_id").select(*order, "coordinates", "bands", "t")
    return by_block(told, lambda key, left, right: links_in_block(key[3], left, right, shingle, percent), "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, rounds: int = ROUNDS) -> DataFrame:
    """(id, n_shingles, set_id, component_id, uid, component) for every row of docs. component_id is the least id of a
    component; where ids repeat or are null, `component` tells components apart (null: no shingles), and `uid` (a hash of id
    and text) rows."""
    signed = cut(signatures(docs, key, text, shingle, bands, rows), "minhash-signed")
    sets = signed.where("set_id is not null").groupBy(F.col("set_id").alias("md5")).agg(
        F.min("id").alias("least"), F.min("uid").alias("uid"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("coordinates").alias("coordinates"))
    # numbered as written, so that what is dealt into buckets is short
    sets = cut(sets.withColumn("set_id", F.monotonically_increasing_id()), "minhash-sets")
    marks = cut(signed.select("id", "uid", "n_shingles", "set_id"), "minhash-marks")
    free(signed)
    places = sets.select("set_id", "n", F.posexplode("bands").alias("at", "h")).select("set_id", "n", "at", F.xxhash64("at", "h").alias("bucket"))
    shared = places.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("bucket")
    places = cut(places.join(cut(shared, "minhash-shared"), "bucket"), "minhash-places")
    wanted = places.select("set_id").distinct().join(sets.select("set_id", "uid"), "set_id")
    texts = docs.select(F.xxhash64(F.col(key).cast("string"), whole(text)).alias("uid"), whole(text).alias("t")).join(wanted, "uid")
    texts = cut(texts.select("set_id", "t").dropDuplicates(["set_id"]), "minhash-texts")

    members, edges, names = places.withColumn("component", F.col("set_id")), None, None
    for r in range(rounds + 1):
        spread = members.groupBy("bucket").agg(
            F.min(F.struct(F.xxhash64("set_id", F.lit(r)).alias("order"), "set_id", "n", "component")).alias("pivot"), F.min("component").alias("c0"), F.max("component").alias("c1"))
        spread = cut(spread.where("c0 <> c1").select("bucket", "pivot"), "minhash-open")
        if spread.isEmpty():
            break
        if r < rounds:
            pairs = members.join(spread, "bucket").where(F.col("component") != F.col("pivot.component")).where(_sizes_allow("n", "pivot.n", percent))
            pairs = pairs.select(F.col("pivot.set_id").alias("a"), F.col("set_id").alias("b")).distinct()
            found = confirm(pairs, sets, texts, shingle, percent)
        else:
            found = rest_of_buckets(cut(members.join(spread.select("bucket"), "bucket"), "minhash-rest"), sets, texts, shingle, percent)
        found = cut(found, "minhash-links")
        if found.isEmpty():
            continue
        edges = found if edges is None else edges.union(found)
        # components so far stand for the links inside them
        names = cut(components(edges), "minhash-components")
        edges = names.select(F.col("id").alias("a"), F.col("component").alias("b")).where("a <> b")
        if r < rounds:
            members = cut(places.join(spread.select("bucket"), "bucket").join(names.select(F.col("id").alias("set_id"), "component"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id")), "minhash-members")
    free(texts, places)
    of = sets.select("set_id", "md5", "least")
    if names is None:
        of_set = of.select("md5", F.col("set_id").alias("component"), F.col("least").alias("component_id"))
    else:
        of = cut(of.join(names.select(F.col("id").alias("set_id"), "component"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id")), "minhash-of")
        least = cut(of.groupBy("component").agg(F.min("least").alias("component_id")), "minhash-least")
        of_set = cut(of.join(least, "component").select("md5", "component", "component_id"), "minhash-names")
    out = marks.join(of_set.withColumnRenamed("md5", "set_id"), "set_id", "left")
    return out.select("id", "n_shingles", "set_id", F.when(F.col("set_id").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"), "uid", "component")


#: All pairs that share a shingle; components by following links from each document.
SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(lower_ascii, '[^\x20\x09-\x0D]+') ws from (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') lower_ascii from documents)),
s as (
  select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
                                      else list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' ')) end) x from w),
n as (select doc_id, count(*) n from s group by doc_id),
p as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.x = b.x and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 80 * (na.n + nb.n - c)),
r as (select a, b from l union select r.a, l.b from r join l on r.b = l.a),
c as (select a, least(a, min(b)) component_id from r group by a)
select w.doc_id, coalesce(n, 0) n_shingles, coalesce(component_id, w.doc_id) component_id, coalesce(component_id, w.doc_id) = w.doc_id kept
from w left join n on n.doc_id = w.doc_id left join c on c.a = w.doc_id
"""


def query(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
