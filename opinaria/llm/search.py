"""Ranked lexical search with an index in strata of equal length.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z lower-cased. All arithmetic is in whole
numbers, so that equal scores are equal: a term weighs w = floor(1000 ln((2N+2) / (2df+1))), a document's normaliser is
m = 25 + (75 n N) div L, and an occurrence count tf has the impact (10^9 tf) div (1000 tf + 8 m).

1. terms: one pass over the texts gives each document's n and, of the terms that some item asks for, the counts. N, L and df
   are sums over what it wrote, so all documents count in them.
2. index: documents go into strata of equal m. In a stratum an impact depends on tf alone, so postings are grouped by (term,
   tf) and each impact is worked out once for a group. A stratum with many postings is cut into units of about `UNIT` by a
   hash of the documents' numbers, and units are what is dealt out: a length that a third of all documents have is many units.
3. search: a unit bounds an item's score by its terms' largest tf. A task visits units from the largest bound down and leaves
   the rest as soon as a bound is below the item's tenth best score so far. A visit adds up the postings of the item's terms.
   The ten best of each task are merged by (score, document).

The items are a stated query set: they are read in blocks of `ITEMS` items and `ASKED` terms at most (one item at least), and
each block meets all documents.

Defined cases. Null or empty text, or one without terms: in no count and no result; as an item: no rows. Very long texts are
read whole, their counts in rows of 256 terms. Ties: by ascending document key, null keys last; then any of equal rows, which
can't be told apart. Repeated rows are documents of their own, repeated items get results of their own. Empty tables: no
rows. Columns are read by name, so others may have any name. N n of a document must stay below 2^56."""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from opinaria.sources.scratch import cut, free

from .common import slices, small

#: Items and terms (with repeats) of a block; postings of a unit; postings whose visits a task orders at a time; terms in a row.
ITEMS, ASKED, UNIT, ORDERED, ROW = 4096, 1 << 18, 1 << 18, 1 << 23, 256
#: Bytes to themselves, A-Z to a-z, and what isn't part of a term to a space.
_FOLD = bytes(c if c >= 128 or chr(c).isalnum() and not chr(c).isupper() else c + 32 if chr(c).isupper() else 32 for c in range(256))


def terms(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


class Block:
    """Items that are searched together: their terms numbered, with how often each item asks for a term."""

    def __init__(self) -> None:
        self.keys: list = []
        self.numbers: dict[bytes, int] = {}
        self.asked, self.repeats, self.sizes, self.held = [], [], [], 0

    def add(self, key, text: str) -> None:
        found = Counter(terms(text))
        self.keys.append(key)
        self.asked += [self.numbers.setdefault(t, len(self.numbers)) for t in found]
        self.repeats += found.values()
        self.sizes.append(len(found))
        self.held += found.total()

    def full(self) -> bool:
        return len(self.keys) >= ITEMS or self.held >= ASKED


def blocks(items: DataFrame, item: str, text: str) -> Iterator[Block]:
    """The items in blocks, which alone are held; a block's text is read when the one before is done."""
    block = Block()
    for key, query in items.select(F.col(item), F.col(text).cast("string")).toLocalIterator():
        block.add(key, query or "")
        if block.full():
            yield block
            block = Block()
    if block.keys:
        yield block


def counted(docs: DataFrame, numbers: dict[bytes, int], key: str, text: str) -> DataFrame:
    """(uid, doc, n, head, terms, counts): of each document with terms, those that have numbers, in rows of `ROW`; every
    document has one row with `head`."""
    known = docs.sparkSession.sparkContext.broadcast(numbers)
    kind = docs.schema[key].dataType
    ints = T.ArrayType(T.IntegerType(), False)
    out = T.StructType([T.StructField("uid", T.LongType()), T.StructField("doc", kind), T.StructField("n", T.LongType()), T.StructField("head", T.BooleanType()), T.StructField("terms", ints), T.StructField("counts", ints)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, uid = known.value.get, TaskContext.get().partitionId() << 33
        for part, texts in slices(batches, "text_"):
            at, uids, sizes, heads, ids, tfs = [], [], [], [], [], []
            for i, text in enumerate(texts):
                found = terms(text)
                if not found:
                    continue
                own = [(t, n) for w, n in Counter(found).items() if (t := number(w)) is not None]
                for lo in range(0, max(1, len(own)), ROW):
                    at.append(i)
                    uids.append(uid)
                    sizes.append(len(found))
                    heads.append(lo == 0)
                    ids.append([t for t, _ in own[lo : lo + ROW]])
                    tfs.append([n for _, n in own[lo : lo + ROW]])
                uid += 1
            kept = part.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), kept, pa.array(sizes, pa.int64()), pa.array(heads, pa.bool_()), pa.array(ids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))], names=out.names)

    return docs.select(F.col(key).alias("key_"), F.col(text).cast("string").alias("text_")).mapInArrow(run, out)


def impact(tf: np.ndarray, m: int) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Unit:
    """Documents of one m, their postings by term and tf, each with its weighted impact."""

    def __init__(self, m: int, docs: pa.Array, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, weights: np.ndarray):
        order = np.lexsort((doc, -tf, term))
        self.docs, self.doc, term, tf = docs, doc[order], term[order], tf[order]
        first = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (tf[1:] != tf[:-1]))))
        worth = weights[term[first]] * impact(tf[first], m)  # once for a (term, tf)
        self.worth = np.repeat(worth, np.diff(np.append(first, len(term))))
        begins = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
        self.terms, self.starts = term[begins], np.append(begins, len(term))
        self.largest = self.worth[begins]  # tf falls within a term

    def bounds(self, asked: np.ndarray, repeats: np.ndarray, firsts: np.ndarray, n_terms: int) -> np.ndarray:
        """The most that a document can score, for each item."""
        best = np.zeros(n_terms, np.int64)
        best[self.terms] = self.largest
        return np.add.reduceat(best[asked] * repeats, firsts)

    def visit(self, asked: np.ndarray, repeats: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places of documents, scores) of the k best that score `least` or more, equal scores by place."""
        at = np.searchsorted(self.terms, asked)
        at[at == len(self.terms)] = 0
        here = self.terms[at] == asked
        lo, size, times = self.starts[at[here]], (self.starts[at + 1] - self.starts[at])[here], repeats[here]
        places = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
        scores = np.zeros(len(self.docs), np.int64)
        np.add.at(scores, self.doc[places], self.worth[places] * np.repeat(times, size))
        found = np.flatnonzero(scores >= least)
        if len(found) > k:
            own = scores[found]
            cut_at = np.partition(own, len(own) - k)[len(own) - k]
            above, equal = found[own > cut_at], found[own == cut_at]
            found = np.concatenate((above, equal[: k - len(above)]))
        return found, scores[found]


def best(index: DataFrame, block: Block, weights: np.ndarray, k: int) -> DataFrame:
    """(item, doc, score): the k best of each item and task. `index` has rows (m, unit, doc, uid, terms, counts), those of a
    unit on end."""
    asking = [i for i, n in enumerate(block.sizes) if n]
    sizes = np.array([block.sizes[i] for i in asking], np.int64)
    sent = index.sparkSession.sparkContext.broadcast((np.array(asking, np.int32), np.array(block.asked, np.int64), np.array(block.repeats, np.int64), np.cumsum(sizes) - sizes, weights))
    out = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("doc", index.schema["doc"].dataType), T.StructField("score", T.LongType())])

    def units(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[Unit]:
        key, held = None, []

        def made() -> Unit:
            rows = pa.Table.from_batches(held)
            uid = rows.column("uid").to_numpy()
            new = np.concatenate(([True], uid[1:] != uid[:-1]))
            lists = rows.column("terms").combine_chunks()
            size = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
            doc = np.repeat(np.cumsum(new) - 1, size)
            flat = [rows.column(c).combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("terms", "counts")]
            return Unit(key[0], rows.column("doc").combine_chunks().take(pa.array(np.flatnonzero(new))), doc, *flat, weights)

        for batch in batches:
            m, unit = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero((m[1:] != m[:-1]) | (unit[1:] != unit[:-1])) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(m)]):
                if lo == hi:
                    continue
                if held and (m[lo], unit[lo]) != key:
                    yield made()
                    held = []
                key = (m[lo], unit[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield made()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asking, asked, repeats, firsts, weights = sent.value
        ends = np.append(firsts, len(asked))[1:]
        top: list[tuple[np.ndarray, list]] = [(np.zeros(0, np.int64), [])] * len(asking)
        kind = out["doc"].dataType

        def visit(group: list[Unit]) -> None:
            bound = np.array([u.bounds(asked, repeats, firsts, len(weights)) for u in group])
            for i in range(len(asking)):
                mine = slice(firsts[i], ends[i])
                for j in np.argsort(-bound[:, i], kind="stable"):
                    scores, docs = top[i]
                    least = max(1, int(scores[-1])) if len(scores) == k else 1
                    if bound[j, i] < least:
                        break
                    at, found = group[j].visit(asked[mine], repeats[mine], least, k)
                    if len(at):
                        docs = docs + group[j].docs.take(pa.array(at)).to_pylist()
                        scores = np.concatenate((scores, found))
                        order = sorted(range(len(docs)), key=lambda x: (-scores[x], docs[x] is None, docs[x] if docs[x] is not None else 0))[:k]
                        top[i] = scores[order], [docs[x] for x in order]

        group, held = [], 0
        for unit in units(batches, weights):
            group.append(unit)
            held += len(unit.doc)
            if held >= ORDERED:
                visit(group)
                group, held = [], 0
        if group:
            visit(group)
        rows = [(int(asking[i]), d, int(s)) for i, (scores, docs) in enumerate(top) for s, d in zip(scores, docs)]
        if rows:
            item, doc, score = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, to_arrow_type(kind)), pa.array(score, pa.int64())], names=out.names)

    return index.mapInArrow(run, out)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", query: str = "text", k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score) under the names of `item` and `key`: each item's k best documents with a score above 0."""
    spark = docs.sparkSession
    kinds = T.StructType([T.StructField("i", items.schema[item].dataType), T.StructField("rank", T.IntegerType()), T.StructField("d", docs.schema[key].dataType), T.StructField("score", T.LongType())])
    out = spark.createDataFrame([], kinds)
    for block in blocks(items, item, query):
        if block.asked:
            names = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("i", items.schema[item].dataType)])
            of = spark.createDataFrame(list(enumerate(block.keys)), names)
            rows = cut(counted(docs, block.numbers, key, text), "search-terms")
            found = _search(rows, block, k).join(F.broadcast(of), "item")
            out = out.unionByName(cut(found.select("i", "rank", F.col("doc").alias("d"), "score"), "search-best"))
            free(rows)
    return out.select(F.col("i").alias(item), "rank", F.col("d").alias(key), "score")


def _search(rows: DataFrame, block: Block, k: int) -> DataFrame:
    """(item, rank, doc, score) from what `counted` has written."""
    total = rows.where("head").agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    df = np.zeros(len(block.numbers), np.int64)
    for r in rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect():  # a row for each of the block's terms at most
        df[r.term] = r.df
    weights = np.array([weight(total.docs, int(x)) for x in df], np.int64)
    rows = rows.where(F.size("terms") > 0).withColumn("m", F.lit(25) + F.expr(f"(75 * n * {total.docs}L) div {max(1, total.terms)}L"))
    strata = small(cut(rows.groupBy("m").agg(F.ceil(F.sum(F.size("terms")) / UNIT).cast("int").alias("units")), "search-strata"))
    index = rows.join(strata, "m").withColumn("unit", F.pmod(F.xxhash64("uid"), F.col("units")).cast("int"))
    order = ["m", "unit", F.col("doc").isNull(), "doc", "uid"]
    index = index.repartition("m", "unit").sortWithinPartitions(*order).select("m", "unit", "doc", "uid", "terms", "counts")
    by_score = W.partitionBy("item").orderBy(F.desc("score"), F.col("doc").asc_nulls_last())
    return best(index, block, weights, k).withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)


def query(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return search(docs, items)


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
with d as (select row_number() over () uid, doc_id, regexp_extract_all({_FOLDED}, '{_TERM}') terms from documents),
s as (select count(*) n_docs, cast(sum(len(terms)) as bigint) n_terms from d where len(terms) > 0),
q as (select item_id, term, count(*) times from (select item_id, unnest(regexp_extract_all({_FOLDED}, '{_TERM}')) term from benchmark) group by all),
p as (select uid, doc_id, n, term, count(*) tf from (select uid, doc_id, len(terms) n, unnest(terms) term from d) where term in (select term from q) group by all),
w as (select term, cast(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) as bigint) w from (select term, count(*) df from p group by term), s),
r as (select item_id, uid, doc_id, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) as bigint) score
      from q join p using (term) join w using (term), s group by all)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) rank, doc_id, score
from r where score > 0 qualify rank <= 10
"""
