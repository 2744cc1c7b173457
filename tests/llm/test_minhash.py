import random

import pytest
from pyspark.sql import functions as F

from opinaria.llm import minhash as M
from opinaria.llm.components import components
from tests.oracle import same


def brute(rows, shingle, percent=80):
    """(id, n, smallest reachable id) by comparing all pairs that share a shingle."""
    sets = [M.shingle_set(M.words_of(t or ""), shingle) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    seen = set()
    for ids in where.values():
        for k, i in enumerate(ids):
            for j in ids[:k]:
                if (i, j) not in seen:
                    seen.add((i, j))
                    c = len(sets[i] & sets[j])
                    if 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
                        parent[root(i)] = root(j)
    name = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            name[root(i)] = min(d, name.get(root(i), d))
    return sorted(((d, len(sets[i]), name.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def family(seed, n=60, words=120):
    """Copies that drift: each changes words of an earlier one, so a component is a web, not a star."""
    r = random.Random(seed)
    base = [[f"w{r.randrange(900)}" for _ in range(words)]]
    for _ in range(n):
        w = list(r.choice(base))
        for _ in range(r.randrange(8)):
            w[r.randrange(words)] = f"x{r.randrange(10**6)}"
        base.append(w)
    return [" ".join(w) for w in base]


@pytest.mark.parametrize("rows", [
    [],
    [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE  two"), (5, "one two"), (None, "one two"), (None, None), (7, "a b c d e f"), (8, "A b\tc d e f")],
    [(i, "the very same text of some words") for i in range(50)] + [(99, "z " * 50_000)],
    [(i, t) for i, t in enumerate(family(1) + family(2) + ["unrelated words in here %d" % i for i in range(20)])],
    [(1000 - i, t) for i, t in enumerate(family(3, 150, 60))],
])
def test_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "'x' as set_id")
    got = sorted(((r.id, r.n_shingles, r.component_id) for r in M.near_duplicates(df, shingle=4, rounds=1).collect()), key=repr)
    assert got == brute(rows, 4)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = M.query(spark, sf).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows, 4)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(r.randrange(40), r.randrange(40)) for _ in range(25)] + [(7, 7), (500, 501)]
    got = dict(tuple(x) for x in components(spark.createDataFrame(edges, "a long, b long")).collect())
    name = {n: n for e in edges for n in e}
    for _ in name:
        for a, b in edges:
            name[a] = name[b] = min(name[a], name[b])
    assert got == {k: v for k, v in name.items() if any(k in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_against_sql(spark):
    assert same(M.query(spark, "/root/testdata/sf0.01"), M.SQL, "/root/testdata/sf0.01") == 1000


def test_blocks(spark, monkeypatch):
    """Many small blocks give what one gives, without a round of pivots before."""
    monkeypatch.setattr(M, "BLOCK", 16)
    rows = [(i, t) for i, t in enumerate(family(7, 120, 60))]
    got = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4, rounds=0).collect()
    assert sorted(((r.id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows, 4)
