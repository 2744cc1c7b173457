"""Byte-level BPE encoding and decoding by merge replay over the corpus.

1. parts: each text is split once, by the splitting pattern. In a part of the corpus (`PART` characters of a task) each distinct
   piece gets a number; a text becomes the numbers of its pieces, packed. A part's pieces are packed by buckets of a hash of the
   piece. All of it is written to the shared folder, in buckets of the part.
2. replay: a bucket's pieces of all parts meet in a task, so that each distinct piece is merged once for the whole corpus. An
   inverted index maps the rank of a pair of neighbours to the positions where it stands in a table of pieces, each spelled in
   single bytes. Merges are replayed in rank order over the table at once; each touches only the two neighbours of a merged
   pair and moves them in the index.
3. texts: the ids of a part's pieces go back to the part, where the packed texts lie, and each text is put together from them.

Nothing comes to the driver but the number of characters, which gives the numbers of buckets, and nothing is broadcast. What
moves is the distinct pieces of each part and their ids, once each; the packed texts are written once and stay there.

Ranks are those of the joined bytes, as in tiktoken's files: any neighbours whose joined bytes have a rank may merge,
so a merge can bring up a lower rank than its own, which the replay then does first in that piece.

Defined cases. Null or empty text: no ids. Any Unicode text comes back byte for byte; special tokens don't exist. Very long
texts are encoded whole, in a part of their own. Ties: of overlapping equal pairs, as in aaa, the left one merges. Repeated
rows are encoded alike, each gives a row. Empty table: no rows. Columns are read by name, so others may have any name."""
from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from opinaria.sources.scratch import cut

from .common import slices

#: Characters of a part; characters split at a time.
PART, SPLIT = 1 << 24, 1 << 21
#: Bytes of pieces that are replayed together; pieces of texts that are put together at a time.
TABLE, TOGETHER = 1 << 22, 1 << 20
#: Characters of the corpus for each bucket of pieces.
BUCKET = 1 << 25


def read_ranks(path: str) -> dict[bytes, int]:
    """Bytes to rank, from a file of base64 bytes and rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Replay:
    """Encodes tables of pieces. A bucket of the index is worked off as arrays, so a merge that stands in thousands of
    pieces costs as many steps as one that stands in a single one."""

    def __init__(self, ranks: dict[bytes, int]):
        self.spelled, self.ranks = {r: b for b, r in ranks.items()}, ranks
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.shift = max(ranks.values()).bit_length()
        # every way to put a token together from two others
        found = {ranks[t[:i]] << self.shift | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.pairs = np.array(sorted(found), np.int64)
        self.joined = np.array([found[k] for k in self.pairs.tolist()], np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of two neighbours joined, -1 if they don't merge."""
        if not len(self.pairs):
            return np.full(len(a), -1)
        key = a << self.shift | b
        at = np.searchsorted(self.pairs, key)
        at[at == len(self.pairs)] = 0
        return np.where(self.pairs[at] == key, self.joined[at], -1)

    def encode(self, pieces: Iterable[bytes]) -> list[list[int]]:
        pieces = list(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        n = int(sizes.sum())
        if not n:
            return [[] for _ in pieces]
        starts = np.cumsum(sizes) - sizes
        tok = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        piece = np.repeat(np.arange(len(pieces)), sizes)
        alive = np.ones(n, bool)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[starts + sizes - 1], before[starts] = n, -1  # n and -1: no neighbour
        here = np.full(n + 1, -1)  # rank of the pair that starts at a position
        inner = np.flatnonzero(after < n)
        here[inner] = self.rank(tok[inner], tok[inner + 1])
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def file(at: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)]):
                r = int(ranks[lo])
                if r not in index:
                    index[r] = []
                    heappush(queue, r)
                index[r].append(at[lo:hi])

        inner = inner[here[inner] >= 0]
        if len(inner):
            file(inner, here[inner])
        while queue:
            r = heappop(queue)
            places = index.pop(r)
            at = np.sort(np.concatenate(places)) if len(places) > 1 else places[0]
            at = at[here[at] == r]  # a neighbour of the others has merged meanwhile
            if len(at) > 1:
                at = at[np.concatenate(([True], at[1:] != at[:-1]))]
                # of pairs that overlap, as in aaa, every second one from the left
                follows = np.concatenate(([False], after[at[:-1]] == at[1:]))
                if follows.any():
                    number = np.arange(len(at))
                    at = at[(number - np.maximum.accumulate(np.where(follows, 0, number))) % 2 == 0]
            if not len(at):
                continue
            if len(at) > 1 and (again := piece[at[1:]] == piece[at[:-1]]).any():
                # several in one piece: only the first may merge if that brings up a lower rank next to it
                first = ~np.concatenate(([False], again))
                right, left, new = after[after[at]], before[at], np.full(len(at), r)
                lower = np.zeros(len(at), bool)
                k, m = np.flatnonzero(right < n), np.flatnonzero(left >= 0)
                for at_k, x in ((k, self.rank(new[k], tok[right[k]])), (m, self.rank(tok[left[m]], new[m]))):
                    lower[at_k] |= (x >= 0) & (x < r)
                twice = self.rank(new[:1], new[:1])[0]
                lower |= 0 <= twice < r
                wait = np.isin(piece[at], piece[at[lower]]) & ~first
                if wait.any():
                    index[r] = [at[wait]]
                    heappush(queue, r)
                    at = at[~wait]
            gone = after[at]
            right, left = after[gone], before[at]
            tok[at], alive[gone], here[gone] = r, False, -1
            after[at] = right
            k = right < n
            before[right[k]] = at[k]
            # touched neighbours: the pair that starts here, and the one that ends here
            here[at] = -1
            both = np.concatenate((at[k], left[left >= 0]))
            both = both[alive[both]]
            if len(both):
                both = np.unique(both) if len(both) > 1 else both
                ranks = self.rank(tok[both], tok[after[both]])
                here[both] = ranks
                yes = ranks >= 0
                if yes.any():
                    file(both[yes], ranks[yes])
        left = tok[alive].tolist()
        ends = np.cumsum(np.bincount(piece[alive], minlength=len(pieces))).tolist()
        return [left[a:b] for a, b in zip([0, *ends], ends)]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.spelled.__getitem__, ids))


class Numbers(dict):
    """Pieces by the order in which they are first looked up."""

    def __missing__(self, piece: str | bytes) -> int:
        self[piece] = n = len(self)
        return n


def pack(numbers: np.ndarray) -> bytes:
    """Numbers by planes of bytes, as the high ones are mostly zero."""
    return zlib.compress(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), 6)


def unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1).T.copy().view("<i4").ravel()


def pack_text(numbers: np.ndarray, known: int) -> bytes:
    """A text's numbers, of a part that had `known` pieces before it. Its new pieces have the next numbers in turn, so 0 says
    that there is one; the others are one up."""
    top = np.maximum.accumulate(np.concatenate(([known - 1], numbers)))[:-1]
    return pack(np.concatenate(([known], np.where(numbers > top, 0, numbers + 1))))


def unpack_text(packed: bytes) -> np.ndarray:
    known, x = (y := unpack(packed))[0], y[1:]
    new = x == 0
    return np.where(new, known - 1 + np.cumsum(new), x - 1)


def pack_lists(lists: list[bytes]) -> tuple[bytes, bytes]:
    """Sizes and bytes."""
    return pack(np.fromiter(map(len, lists), np.int32, len(lists))), zlib.compress(b"".join(lists), 6)


def unpack_lists(sizes: bytes, joined: bytes) -> list[bytes]:
    ends, whole = np.cumsum(unpack(sizes), dtype=np.int64).tolist(), zlib.decompress(joined)
    return [whole[a:b] for a, b in zip([0, *ends], ends)]


def parts(texts: DataFrame, pattern: str, buckets: int) -> DataFrame:
    """texts: (k, t). Rows of two kinds: (part, k, packed) for a text, and (part, bucket, numbers, sizes, pieces) for a part's
    pieces of a bucket, in the order of their numbers."""
    kind = texts.schema["k"].dataType
    schema = T.StructType([T.StructField("part", T.LongType()), T.StructField("bucket", T.IntegerType()), *(T.StructField(n, T.BinaryType()) for n in ("numbers", "sizes", "pieces")), T.StructField("k", kind), T.StructField("packed", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        from pyspark import TaskContext

        split, names = regex.compile(pattern).findall, schema.names
        part, numbers, held, kind = TaskContext.get().partitionId() << 32, Numbers(), 0, None

        def spelled() -> pa.RecordBatch:
            pieces = [p.encode() for p in numbers]
            bucket = np.fromiter(map(zlib.crc32, pieces), np.int64, len(pieces)) % buckets
            order = np.argsort(bucket, kind="stable")
            first = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            groups = np.split(order, first[1:])
            packed = [pack_lists([pieces[i] for i in g.tolist()]) for g in groups]
            cols = [pack(np.diff(g, prepend=0)) for g in groups], [p[0] for p in packed], [p[1] for p in packed]
            n = len(groups)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, part)), pa.array(bucket[order][first].astype(np.int32)), *(pa.array(c, pa.binary()) for c in cols), pa.nulls(n, kind), pa.nulls(n, pa.binary())], names=names)

        for batch, some in slices(batches, "t", SPLIT):
            n, kind = len(some), batch.column(0).type
            # a text at a time, so that its pieces don't outlive it
            packed = [pack_text(known=len(numbers), numbers=np.fromiter(map(numbers.__getitem__, split(t)), np.int64)) for t in some]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part)), pa.nulls(n, pa.int32()), *[pa.nulls(n, pa.binary())] * 3, batch.column(0), pa.array(packed, pa.binary())], names=names)
            held += sum(map(len, some))
            if held >= PART:
                if numbers:
                    yield spelled()
                part, numbers, held = part + 1, Numbers(), 0
        if numbers:
            yield spelled()

    return texts.select("k", "t").mapInArrow(run, schema)


def replayed(pieces: DataFrame, ranks_path: str) -> DataFrame:
    """(part, bucket, numbers, sizes, pieces) -> (part, numbers, sizes, ids). Each distinct piece of a bucket is merged once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = Replay(read_ranks(ranks_path))

        def encoded(distinct: Numbers, rows: list[tuple]) -> pa.RecordBatch:
            """rows: (part, numbers, places in distinct)"""
            ids, some, size = [], [], 0
            for p in distinct:
                some.append(p)
                size += len(p)
                if size >= TABLE:
                    ids += replay.encode(some)
                    some, size = [], 0
            ids += replay.encode(some)
            size = np.fromiter(map(len, ids), np.int32, len(ids))
            packed = [(pack(size[at]), pack(np.fromiter((x for i in at.tolist() for x in ids[i]), np.int32))) for _, _, at in rows]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array(c, pa.binary()) for c in ([r[1] for r in rows], [p[0] for p in packed], [p[1] for p in packed]))], names=["part", "numbers", "sizes", "ids"])

        now, distinct, rows = None, Numbers(), []
        for batch in batches:
            for part, bucket, numbers, sizes, joined in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != now:
                    if rows:
                        yield encoded(distinct, rows)
                    now, distinct, rows = bucket, Numbers(), []
                rows.append((part, numbers, np.fromiter(map(distinct.__getitem__, unpack_lists(sizes, joined)), np.int32)))
        if rows:
            yield encoded(distinct, rows)

    rows = pieces.select("part", "bucket", "numbers", "sizes", "pieces").repartition("bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(run, "part long, numbers binary, sizes binary, ids binary")


@lru_cache(maxsize=1)
def _tokens(ranks_path: str) -> tuple[list[bytes], list[str]]:
    """Bytes and number, as text, of each id."""
    spelled = {i: b for b, i in read_ranks(ranks_path).items()}
    spelled = [spelled.get(i, b"") for i in range(max(spelled) + 1)]
    return spelled, list(map(str, range(len(spelled))))


def encode(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """(key, ids, decoded): the ids of each text and what they decode to, as bytes; with digest, the number of ids, the
    sha256 of the ids as text and that of the decoded bytes instead. `ranks_path` is a file on every machine."""
    texts = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    characters = texts.agg(F.sum(F.length("t"))).first()[0] or 0
    rows = cut(parts(texts, pattern, 16 + characters // BUCKET), "bpe-parts", buckets=(min(16 + characters // PART, 100_000), "part"))
    out = T.StructType([T.StructField(key, docs.schema[key].dataType), *(T.StructField(n, t) for n, t in (
        (("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())) if digest
        else (("ids", T.ArrayType(T.IntegerType())), ("decoded", T.BinaryType()))))])
    kinds = [pa.int64(), pa.string(), pa.string()] if digest else [pa.list_(pa.int32()), pa.binary()]

    def run(pieces: pa.Table, packed: pa.Table) -> pa.Table:
        """A part's pieces with their ids, and its texts."""
        spelled, said = _tokens(ranks_path)

        def table(known: list[tuple[bytes, bytes, bytes]]) -> tuple:
            """Of a part's pieces, by number: ids, how many they are, as text, and as bytes."""
            known = [(np.cumsum(unpack(at)).tolist(), np.cumsum(unpack(sizes)).tolist(), unpack(some).tolist()) for at, sizes, some in known]
            ids = [None] * sum(len(at) for at, _, _ in known)
            for at, ends, some in known:
                for i, lo, hi in zip(at, [0, *ends], ends):
                    ids[i] = some[lo:hi]
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            return ids, size, [" ".join([said[i] for i in x]) for x in ids] if digest else None, [b"".join([spelled[i] for i in x]) for x in ids]

        def put_together(keys: pa.Array, found: list[np.ndarray], known: tuple) -> pa.RecordBatch:
            ids, size, as_text, back = known
            lists = [x.tolist() for x in found]
            if digest:
                cols = [[int(size[x].sum()) for x in found], [hashlib.sha256(" ".join([as_text[i] for i in x]).encode()).hexdigest() for x in lists], [hashlib.sha256(b"".join([back[i] for i in x])).hexdigest() for x in lists]]
            else:
                cols = [[np.fromiter((y for i in x for y in ids[i]), np.int32) for x in lists], [b"".join([back[i] for i in x]) for x in lists]]
            return pa.RecordBatch.from_arrays([keys, *(pa.array(c, kind) for c, kind in zip(cols, kinds))], names=out.names)

        ready = table(list(zip(*(pieces.column(c).to_pylist() for c in ("numbers", "sizes", "ids")))))
        keys, texts = packed.column("k").combine_chunks(), packed.column("packed")
        done, start, found, held = [], 0, [], 0
        for i in range(len(keys)):
            found.append(unpack_text(texts[i].as_py()))
            held += len(found[-1])
            if held >= TOGETHER or i == len(keys) - 1:
                done.append(put_together(keys.slice(start, i + 1 - start), found, ready))
                start, found, held = i + 1, [], 0
        return pa.Table.from_batches(done)

    of_pieces = replayed(rows.where("bucket is not null"), ranks_path)
    of_texts = rows.where("bucket is null").select("part", "k", "packed")
    return of_pieces.groupBy("part").cogroup(of_texts.groupBy("part")).applyInArrow(run, out)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, digest=True)
