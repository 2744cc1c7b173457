import numpy as np
import pytest
from pyspark.sql import functions as F

from opinaria.llm import negatives as N
from tests.oracle import same


def brute(rows, anchor, positives=5, negatives=5, low=80, high=100):
    """Every anchor against every row. rows: (id, vector, label)."""
    rows = [(i, [int(np.floor(256 * float(x))) for x in v], y) for i, v, y in rows if y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    order = lambda r: (-r[0], r[1] is None, r[1] or 0, r[2])
    out = []
    for n, (i, v, y) in enumerate(rows):
        if i is None or not anchor(i):
            continue
        others = [(score(v, w), j, m, z) for m, (j, w, z) in enumerate(rows) if m != n and len(w) == len(v)]
        for p in sorted((r for r in others if r[3] == y), key=order)[:positives]:
            found = sorted((r for r in others if r[3] != y and low * p[0] <= 100 * r[0] <= high * p[0]), key=order)[:negatives]
            out += [(i, p[1], k, r[1], p[0], r[0]) for k, r in enumerate(found, 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_against_sql(spark):
    assert same(N.query(spark, "/root/testdata/sf0.01"), N.SQL, "/root/testdata/sf0.01") > 0
    assert same(N.query(spark, "/root/testdata/sf0.1"), N.SQL, "/root/testdata/sf0.1") > 0


def made(seed, n, dim=6):
    """Clusters, copies across and inside labels, ties, zeros, vectors of another length, and rows that take no part."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(5, dim))
    out = [(i, (centres[i % 5] + r.normal(size=dim) * (0.02 if i % 3 else 1)).tolist(), int(i * 7 % 4)) for i in range(n)]
    copy = out[3][1]
    out += [(1000 + i, copy, i % 4) for i in range(40)] + [(10, copy, 1), (None, copy, 2), (None, copy, 1), (20, copy, 1), (20, copy, 1)]
    out += [(2000, [0.0] * dim, 1), (2010, [0.0] * dim, 1), (2020, [0.0] * dim, 2), (3000, [1.0, 2.0], 1), (3001, [1.0, 2.0], 1), (3002, [0.9, 2.0], 2), (4000, [], 1), (4001, [], 1), (4002, [], 3)]
    out += [(5000, None, 1), (5010, copy, None), (5020, [float("nan")] * dim, 1), (5030, [float("inf")] + copy[1:], 1), (5040, [None] + copy[1:], 1)]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, small, monkeypatch):
    """The same with centres and blocks of a few points, and with anchors in several blocks."""
    if small:
        for name, value in (("BLOCK", 20), ("LEAF", 3), ("ANCHORS", 25), ("CENTRES", 4)):
            monkeypatch.setattr(N, name, value)
    data = made(1, 300)
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").selectExpr("*", "'clash' q", "map('a', 1) rid", "1 id", "2 window").repartition(5)
    anchor = lambda i: i % 10 == 0
    assert rows(N.hard_negatives(df, F.col("vec_id") % 10 == 0)) == brute(data, anchor)
    assert rows(N.hard_negatives(df, F.col("vec_id") % 10 == 0, positives=2, negatives=7, low=50, high=120)) == brute(data, anchor, 2, 7, 50, 120)


def test_edges(spark):
    df = spark.createDataFrame(made(2, 20), "vec_id long, embedding array<float>, label int")
    assert N.hard_negatives(df.limit(0), F.lit(True)).count() == 0
    assert N.hard_negatives(df, F.lit(False)).count() == 0
    named = df.selectExpr("cast(vec_id as int) label", "embedding block", "cast(label as string) vec_id")
    assert rows(N.hard_negatives(named, F.col("label") % 10 == 0, "label", "block", "vec_id")) == rows(N.hard_negatives(df, F.col("vec_id") % 10 == 0))
    with pytest.raises(Exception, match="a component of"):
        N.hard_negatives(spark.createDataFrame([(1, [2e6], 1)], "vec_id long, embedding array<double>, label int"), F.lit(True)).count()


def test_tree():
    """Each point is below the root once and in one leaf, radii fall from level to level, bounds hold, and points are skipped."""
    r = np.random.default_rng(3)
    points = np.concatenate([np.floor(256 * (c + r.normal(size=(400, 8)) * 0.03)) for c in r.normal(size=(6, 8))]).astype(np.int64)
    points = np.unique(points, axis=0)
    tree = N.Tree(points)
    leaves = [m for m, c in zip(tree.members, tree.children) if not c]
    assert sorted(np.concatenate(leaves).tolist()) == list(range(len(points)))
    assert max(map(len, leaves)) <= N.LEAF
    anchors = points[::97].astype(np.float64)
    sizes = np.sqrt((anchors * anchors).sum(1))
    scores = anchors @ points.T
    for node, members in enumerate(tree.members):
        low, high = tree.bounds(node, anchors / sizes[:, None], sizes)
        assert (scores[:, members].min(1) >= low).all() and (scores[:, members].max(1) <= high).all()
        for c in tree.children[node]:
            ring = not tree.children[c] and tree.centres[c] == tree.centres[node]
            assert set(tree.members[c]) <= set(members) and (ring or tree.angles[c][1] <= tree.angles[node][1] / 2 + 1e-6)
    n = len(anchors)
    best = N.Best(np.full(n, N.LOW + 1), np.full(n, N.LAST), 5)
    every = np.arange(len(points))
    verified = N.descend(tree, every, every, every, points[::97], np.arange(n), best, np.arange(n))
    want = [sorted(zip(-s, every))[:5] for s in scores]
    assert [[(-a, b) for a, b in zip(x, y)] for x, y in zip(best.scores, best.rows)] == want
    one = N.Best(np.full(1, N.LOW + 1), np.full(1, N.LAST), 5)
    assert N.descend(tree, every, every, every, points[:1], np.array([0]), one, np.array([0])) < len(points) / 2 and verified <= len(points)
    windows = N.Best(np.array([int(scores[0].max()) * 2]), np.full(1, N.LAST), 5)
    assert N.descend(tree, every, every, every, points[:1], np.array([0]), windows, np.array([0])) == 0
