import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from opinaria.llm import search as S
from tests.oracle import same

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(docs, items, k=10):
    """Every document against every item, in Python's whole numbers."""
    docs = [(d, Counter(terms(t))) for d, t in docs]
    docs = [(d, c) for d, c in docs if c]
    n_docs, n_terms = len(docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        asked, found = Counter(terms(text)), []
        for d, c in docs:
            m = 25 + 75 * c.total() * n_docs // n_terms
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, q in asked.items() if t in c)
            if score > 0:
                found.append((-score, d is None, d if d is not None else 0, d))
        out += [(item, i, x[3], -x[0]) for i, x in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_against_sql(spark, sf_dir):
    assert same(S.query(spark, sf_dir), S.SQL, sf_dir) > 0


def test_terms():
    for text in ("Naïve CAFÉ's a_b-c 42\x00x\x7fé y ÀB", "", "".join(map(chr, range(1, 0x300)))):
        assert [t.decode() for t in S.terms(text)] == terms(text)


def made(seed, n):
    """Documents with one length that a third has, copies, rare and very common terms, and ids that repeat or are null."""
    r = random.Random(seed)
    vocabulary = [f"w{int(r.paretovariate(0.6)) % 400}" for _ in range(900)]
    docs = [(i, " ".join(r.choices(vocabulary, k=12 if i % 3 == 0 else r.randrange(1, 60)))) for i in range(n)]
    docs += [(10_000 - i, docs[5][1]) for i in range(n // 4)] + [(7, docs[6][1]), (None, docs[5][1]), (None, "w1 w1"), (-1, None), (-2, ""), (-3, "-- !"), (-4, "W1 " * 40_000)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.randrange(1, 25)))) for i in range(20)]
    return docs, [*items, (3, docs[5][1]), (98, "nowhere"), (99, None), (100, "..."), (None, docs[5][1])]


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, small, monkeypatch):
    """The same results when strata are cut into units, units are visited in groups, and items come in blocks."""
    if small:
        for name, n in (("UNIT", 150), ("ORDERED", 400), ("ITEMS", 7), ("ROW", 3)):
            monkeypatch.setattr(S, name, n)
    docs, items = made(4, 400)
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'clash' uid", "1 n", "map('a', 1) terms", "2 m").repartition(5)
    q = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "3 item", "4 rank")
    assert rows(S.search(d, q)) == brute(docs, items)
    assert rows(S.search(d, q, k=3)) == brute(docs, items, 3)


def test_empty(spark):
    docs, items = made(1, 20)
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert S.search(d.limit(0), q).count() == 0 and S.search(d, q.limit(0)).count() == 0
    assert S.search(d, q.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    named = S.search(d.selectExpr("cast(doc_id as string) t", "text body"), q.selectExpr("item_id q", "text body"), "t", "body", "q", "body")
    assert named.columns == ["q", "rank", "t", "score"] and {x.t for x in named.collect()} <= {str(i) for i, _ in docs if i is not None} | {None}


def test_bounds_hold():
    """No document of a unit scores more than the unit's bound, and a visit gives what brute force gives."""
    r = np.random.default_rng(2)
    for m in (25, 100, 7000):
        doc, term = np.nonzero(r.random((50, 30)) < 0.3)
        tf, weights = r.integers(1, 9, len(doc)), r.integers(0, 9000, 30)
        unit = S.Unit(m, None, doc, term, tf, weights)
        unit.docs = range(50)
        asked, repeats = np.array([1, 4, 7, 29]), np.array([2, 1, 1, 3])
        scores = np.zeros(50, np.int64)
        for t, q in zip(asked, repeats):
            for d, w, n in zip(doc, term, tf):
                if w == t:
                    scores[d] += q * weights[t] * (1_000_000_000 * n // (1000 * n + 8 * m))
        assert unit.bounds(asked, repeats, np.array([0]), 30)[0] >= scores.max()
        at, found = unit.visit(asked, repeats, 1, 5)
        assert sorted(zip(-found, at)) == sorted(zip(-scores, range(50)))[:5]
