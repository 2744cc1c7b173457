"""Hard negatives by inner product, with cover trees over norm-augmented vectors.

A component x counts as floor(256 x), so scores are whole numbers. An anchor's positives are its best rows of the same label. For
each positive, the negatives are the best rows of other labels whose score lies in a window: from `low` to `high` hundredths of
the positive's score.

1. points: rows of one label with equal vectors are one point, which keeps as many of the smallest ids as a result can hold,
   one more for the anchor itself; so copies never meet.
2. blocks: points are dealt by label and by the nearest of some centres, which come from a bounded sample (`CENTRES` points at
   most); a block with many points is cut by hash into ones of about `BLOCK`. Every point is in a block.
3. trees: in a block with the largest norm M, a vector x is augmented by the component sqrt(M^2 - |x|^2), so all lie on one
   sphere, and the inner product with an anchor, which gets a 0, falls with the angle. A cover tree halves the covering angle
   from level to level; a node keeps its points' least and largest angle to its centre. For an anchor at the angle t to the
   centre, the largest, c, bounds inner products by |a| M cos(t - c) and |a| M cos(t + c), the least, b, by |a| M cos(b - t).
   Points too far apart to be covered by few centres, as most are in many dimensions, lie in rings around their node's.
4. descent: best first, the node with the largest bound before others, for all anchors that still ask for it together. A node
   goes when its bounds lie outside of an anchor's windows, or below what the anchor has found already. Leaves are verified
   in whole numbers.
5. merging: each task's best rows for a window, ranked once more over all tasks.

Anchors are a stated query set. They are read from a written table in blocks of `ANCHORS` rows and `SENT` bytes at most, and
each block meets all trees, for the positives first, then for the negatives.

Defined cases. A null label; a vector that is null or holds a null or non-finite component: the row takes no part. Vectors
meet only those of their own length; empty ones score 0. Ties: by smaller id, null ids last, then any of equal rows. Repeated
rows are rows of their own: each is an anchor, and the others are among its positives. Windows of positives with a negative
score are empty. Components of 2^20 or more in size raise an error, as scores may not fit 64 bits. Empty table: no rows.
Columns are read by name, so others may have any name."""
from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from opinaria.sources.scratch import cut, free

from .common import small

#: Points of a block; points of a leaf; centres with few points that end a level; most centres of blocks; anchors and bytes of
#: vectors sent at once.
BLOCK, LEAF, THIN, CENTRES, ANCHORS, SENT = 4096, 64, 8, 1024, 32_768, 32 << 20
SCALE, LARGEST = 256, 1 << 28
LOW, LAST = np.iinfo(np.int64).min + 1, np.iinfo(np.int64).max


class Tree:
    """A cover tree over one block's points: nodes with a centre, their points' least and largest angle to it, and children."""

    def __init__(self, points: np.ndarray):
        self.points = points
        x = points.astype(np.float64)
        norms = (x * x).sum(1)
        self.size = float(np.sqrt(norms.max(initial=0)))
        scale = self.size or 1.0
        self.on_sphere = np.column_stack((x, np.sqrt(np.maximum(0, self.size**2 - norms)))) / scale
        self.centres: list[int] = []
        self.angles: list[tuple[float, float]] = []
        self.children: list[list[int]] = []
        self.members: list[np.ndarray] = []
        if len(points):
            everything = np.arange(len(points))
            self._node(0, everything, self._angle(0, everything))

    def _angle(self, centre: int, of: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(self.on_sphere[of] @ self.on_sphere[centre], -1, 1))

    def _add(self, parent: int, centre: int, of: np.ndarray, angle: np.ndarray) -> int:
        number = len(self.centres)
        self.centres.append(centre)
        self.angles.append((float(angle.min()) - 1e-7, float(angle.max()) + 1e-7))
        self.children.append([])
        self.members.append(of)
        if parent >= 0:
            self.children[parent].append(number)
        return number

    def _node(self, centre: int, of: np.ndarray, angle: np.ndarray) -> None:
        """Makes a node and, level by level, those below: each point goes to the first centre that covers it at half the angle.
        Centres that cover few points don't become nodes; once THIN of them have been met, the points of this level are too
        far apart to be covered. What is left so goes into leaves, by rings around the node's centre."""
        todo = [(-1, centre, of, angle)]
        while todo:
            parent, centre, of, angle = todo.pop()
            number, widest = self._add(parent, centre, of, angle), float(angle.max())
            if len(of) <= LEAF or widest < 1e-6:
                continue
            left, at, last, loose, thin = of, angle, centre, [], 0
            while len(left):
                own = at <= widest / 2
                if not own.any():  # the last centre's own points are covered: a new centre, the farthest from it
                    last = int(left[np.argmax(at)])
                    at = self._angle(last, left)
                    own = at <= widest / 2
                    own[left == last] = True
                if own.sum() * 8 < LEAF:
                    loose.append(left[own])
                    thin += 1
                else:
                    todo.append((number, last, left[own], at[own]))
                left, at = left[~own], at[~own]
                if thin == THIN:
                    loose.append(left)
                    break
            if loose:
                loose = np.concatenate(loose)
                at = self._angle(centre, loose)
                order = np.argsort(at, kind="stable")
                for lo in range(0, len(loose), LEAF):
                    ring = order[lo : lo + LEAF]
                    self._add(number, centre, loose[ring], at[ring])

    def bounds(self, node: int, anchors: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, most) inner product of each anchor with the points below a node. anchors: of length 1."""
        angle = np.arccos(np.clip(anchors @ self.on_sphere[self.centres[node], :-1], -1, 1))
        reach, (inner, outer) = sizes * self.size, self.angles[node]
        slack = reach * 1e-9 + 0.5
        return reach * np.cos(np.minimum(np.pi, angle + outer)) - slack, reach * np.cos(np.maximum(0, np.maximum(angle - outer, inner - angle))) + slack


class Best:
    """For each window the k best rows so far, as (score, id, row); equal scores go by id, then by row."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.scores = np.full((len(low), k), LOW)
        self.ids, self.rows = np.full((len(low), k), LAST), np.full((len(low), k), LAST)
        self.least = low.copy()  # a score below this is of no use; one that equals it may be, by its id

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """scores: of the windows `at` with some rows."""
        w, c = np.nonzero((scores >= self.least[at, None]) & (scores <= self.high[at, None]))
        if not len(w):
            return
        touched, group = np.unique(w, return_inverse=True)
        of = at[touched]
        window = np.concatenate((np.repeat(np.arange(len(of)), self.k), group))
        score = np.concatenate((self.scores[of].ravel(), scores[w, c]))
        own = np.concatenate((self.ids[of].ravel(), ids[c]))
        row = np.concatenate((self.rows[of].ravel(), rows[c]))
        order = np.lexsort((row, own, -score, window))
        place = np.arange(len(order)) - np.searchsorted(window[order], window[order])
        order = order[place < self.k]  # each window has k entries and more
        for held, new in ((self.scores, score), (self.ids, own), (self.rows, row)):
            held[of] = new[order].reshape(len(of), self.k)
        self.least[of] = np.maximum(self.low[of], self.scores[of, -1])


def descend(tree: Tree, ids: np.ndarray, rows: np.ndarray, point: np.ndarray, anchors: np.ndarray, window: np.ndarray, best: Best, ask: np.ndarray) -> int:
    """Takes a tree's rows into `best` for the windows `ask`, whose anchors are `window`; returns how many points it verified.
    ids, rows: of the tree's rows, `point` says whose vector each has, in order."""
    if not len(tree.centres) or not len(ask):
        return 0
    exact = anchors.astype(np.float64)
    sizes = np.sqrt((exact * exact).sum(1))
    unit = exact / np.where(sizes > 0, sizes, 1)[:, None]
    fits = float(sizes.max(initial=0)) * tree.size < 2**53  # then sums of doubles are whole numbers
    points, queries = (tree.points.astype(np.float64), exact) if fits else (tree.points, anchors)
    queue, verified = [], 0

    def offer(node: int, ask: np.ndarray) -> None:
        own, where = np.unique(window[ask], return_inverse=True)
        least, most = (x[where] for x in tree.bounds(node, unit[own], sizes[own]))
        keep = (most >= best.least[ask]) & (least <= best.high[ask])
        if keep.any():
            most = np.minimum(most, best.high[ask])[keep]
            heappush(queue, (-float(most.max()), node, ask[keep], most))

    offer(0, ask)
    while queue:
        _, node, ask, most = heappop(queue)
        ask = ask[most >= best.least[ask]]
        if not len(ask):
            continue
        if tree.children[node]:
            for child in tree.children[node]:
                offer(child, ask)
            continue
        members = np.sort(tree.members[node])
        verified += len(members)
        own, where = np.unique(window[ask], return_inverse=True)
        scores = (queries[own] @ points[members].T).astype(np.int64)
        lo, hi = np.searchsorted(point, members), np.searchsorted(point, members, "right")
        size = hi - lo
        at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
        best.add(ask, scores[where][:, np.repeat(np.arange(len(members)), size)], ids[at], rows[at])
    return verified


def _points(vectors: DataFrame, is_anchor: Column, key: str, vector: str, label: str) -> DataFrame:
    """(rid, id, label, q, anchor): rows that take part."""
    v = F.col(vector)
    fine = F.col(label).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    large = F.exists("q", lambda x: F.abs(x) >= LARGEST)
    rows = vectors.where(fine).select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.transform(v, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double"))).alias("q"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    q = F.when(large, F.raise_error(F.lit(f"a component of {LARGEST // SCALE} or more"))).otherwise(F.col("q").cast("array<int>"))
    return cut(rows.select(F.monotonically_increasing_id().alias("rid"), "id", "label", q.alias("q"), "anchor"), "negatives-rows")


def _blocks(rows: DataFrame, keep: int) -> DataFrame:
    """(block, label, pid, q, id, rid): points' rows, `keep` of each point, with the block that a point belongs to."""
    by_id = W.partitionBy("label", "q").orderBy(F.col("id").asc_nulls_last(), "rid")
    kept = rows.drop("anchor").withColumn("at", F.row_number().over(by_id)).where(F.col("at") <= keep)
    points = kept.groupBy("label", "q").agg(F.collect_list(F.struct("id", "rid")).alias("own"))  # `keep` at most
    points = cut(points.select(F.monotonically_increasing_id().alias("pid"), "label", "q", "own"), "negatives-points")
    n = points.count()
    sample = [r.q for r in points.orderBy(F.xxhash64("q", "label"), "pid").limit(min(CENTRES, n // (4 * BLOCK))).select("q").collect()]
    cells = cut(points.select("pid", "label", F.size("q").alias("dim"), _cell(sample, "q").alias("cell")), "negatives-cells")
    parts = small(cut(cells.groupBy("label", "dim", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")), "negatives-parts"))
    block = F.xxhash64("label", "dim", "cell", F.pmod(F.xxhash64("pid"), F.col("parts"))).alias("block")
    dealt = cells.join(parts, ["label", "dim", "cell"]).select("pid", block)
    index = cut(points.join(dealt, "pid").select("block", "label", "pid", "q", F.explode("own").alias("own")).select("block", "label", "pid", "q", "own.id", "own.rid"), "negatives-index")
    free(points, cells)
    return index


def _cell(centres: list[list[int]], q: str) -> Column:
    """The number of the nearest centre of the vector's own length, by angle; 0 where there is none."""
    if not centres:
        return F.lit(0)
    by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d in {len(c) for c in centres}:
        number = np.array([i for i, c in enumerate(centres) if len(c) == d])
        x = np.array([centres[i] for i in number], np.float64).reshape(len(number), d)
        by_dim[d] = number, x / np.maximum(1e-300, np.sqrt((x * x).sum(1, keepdims=True)))

    def nearest(column: pd.Series) -> pd.Series:
        found = [by_dim[len(v)][0][np.argmax(by_dim[len(v)][1] @ v)] if len(v) in by_dim else 0 for v in column]
        return pd.Series(found, dtype="int32")

    return F.pandas_udf(nearest, "int")(q)


class Windows:
    """A block of anchors, and the windows that they ask for: (anchor's place, label, low, high) each."""

    def __init__(self, anchors: list, window: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.window, self.low, self.high = window, low, high
        self.labels = np.array([a.label for a in anchors], object)
        dims = np.array([len(a.q) for a in anchors], np.int64)
        #: Of each length: the anchors' places, and their vectors.
        self.by_dim = {int(d): (np.flatnonzero(dims == d), np.array([a.q for a in anchors if len(a.q) == d], np.int64).reshape(int((dims == d).sum()), int(d))) for d in np.unique(dims)}

    def search(self, best: Best, dim: int, label: str, same: bool, points: np.ndarray, ids: np.ndarray, rows: np.ndarray, point: np.ndarray) -> None:
        """Takes the rows of a block of points of one label into `best`: for the anchors of that label, or for the others."""
        if dim not in self.by_dim:
            return
        at, vectors = self.by_dim[dim]
        place = np.full(len(self.labels), -1)
        place[at] = np.arange(len(at))
        ask = np.flatnonzero((place[self.window] >= 0) & ((self.labels[self.window] == label) == same))
        if len(ask):
            descend(Tree(points), ids, rows, point, vectors, place[self.window], best, ask)


def _search(index: DataFrame, windows: Windows, k: int, same: bool) -> DataFrame:
    """(window, score, id, rid): the k best rows of each window and task."""
    sent = index.sparkSession.sparkContext.broadcast(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        best = Best(asked.low, asked.high, k)
        for rows in _groups(batches, "block"):
            # a point has its rows on end; ids that are null come last
            pid = rows.column("pid").to_numpy()
            first = np.flatnonzero(np.concatenate(([True], pid[1:] != pid[:-1])))
            lists = rows.column("q").combine_chunks().take(pa.array(first))
            dim = len(lists[0])
            points = lists.flatten().to_numpy().astype(np.int64).reshape(len(first), dim)
            point = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(pid))))
            ids = rows.column("id").fill_null(LAST).to_numpy()
            asked.search(best, dim, rows.column("label")[0].as_py(), same, points, ids, rows.column("rid").to_numpy(), point)
        window, place = np.nonzero(best.scores > LOW)
        if len(window):
            ids = best.ids[window, place]
            cols = [pa.array(window.astype(np.int64)), pa.array(best.scores[window, place]), pa.array(ids, mask=ids == LAST), pa.array(best.rows[window, place])]
            yield pa.RecordBatch.from_arrays(cols, names=["window", "score", "id", "rid"])

    dealt = index.repartition("block").sortWithinPartitions("block", "pid", F.col("id").asc_nulls_last(), "rid")
    return dealt.mapInArrow(run, "window long, score long, id long, rid long")


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows with equal keys, which stand on end."""
    held, last = [], None
    for batch in batches:
        own = batch.column(key).to_numpy()
        edges = np.flatnonzero(own[1:] != own[:-1]) + 1
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(own)]):
            if lo == hi:
                continue
            if held and own[lo] != last:
                yield pa.Table.from_batches(held)
                held = []
            last = own[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _anchors(rows: DataFrame) -> Iterator[list]:
    """The anchors in blocks, which alone are held."""
    held, size = [], 0
    for row in rows.where("anchor").select("rid", "id", "label", "q").toLocalIterator():
        held.append(row)
        size += 8 * len(row.q)
        if len(held) >= ANCHORS or size >= SENT:
            yield held
            held, size = [], 0
    if held:
        yield held


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("window").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "rid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row where `is_anchor` and each of
    its `positives` best rows of the same label, the `negatives` best rows of other labels whose score is from `low` to `high`
    hundredths of the positive's."""
    spark = vectors.sparkSession
    rows = _points(vectors, is_anchor, key, vector, label)
    index = _blocks(rows, max(positives + 1, negatives))
    out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for anchors in _anchors(rows):
        n = len(anchors)
        everything = Windows(anchors, np.arange(n), np.full(n, LOW + 1), np.full(n, LAST))
        own = {a.rid: i for i, a in enumerate(anchors)}
        found = _ranked(_search(index, everything, positives + 1, True), positives + 1).select("window", "rank", "score", "id", "rid").collect()  # positives + 1 for each anchor of the block at most
        found = [r for r in sorted(found, key=lambda r: (r.window, r.rank)) if own.get(r.rid) != r.window]
        taken, kept = np.zeros(n, np.int64), []
        for r in found:
            if taken[r.window] < positives:
                taken[r.window] += 1
                kept.append((len(kept), anchors[r.window].id, r.id, r.score, r.window))
        score = np.array([x[3] for x in kept], np.int64)
        # 80 p <= 100 s <= 100 p in whole numbers: s from the least that reaches 80 p / 100 to the most within p
        least, most = -(-low * score // 100), high * score // 100
        asked = Windows(anchors, np.array([x[4] for x in kept], np.int64), least, most)
        of = spark.createDataFrame([x[:4] for x in kept], "window long, anchor_id long, positive_id long, positive_score long")
        best = _ranked(_search(index, asked, negatives, False), negatives).join(F.broadcast(of), "window")
        out = out.unionByName(cut(best.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives-found"))
    free(rows, index)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(moved, F.col("vec_id") % 100 == 0)


#: Every anchor against every row.
SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) e
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select a.vec_id anchor_id, a.label anchor_label, b.vec_id, b.label, cast(list_dot_product(a.e, b.e) as bigint) score
      from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where a.vec_id % 100 = 0),
p as (select anchor_id, vec_id positive_id, score positive_score from s where label = anchor_label
      qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as int) rank,
       vec_id negative_id, positive_score, score negative_score
from p join s using (anchor_id) where label <> anchor_label and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
qualify rank <= 5
"""
