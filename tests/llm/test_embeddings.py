import math

import numpy as np
import pytest

from opinaria.llm import embeddings as E
from tests.oracle import same


def brute(rows, least=0.98):
    n = len(rows)
    unit = []
    for _, label, v in rows:
        ok = label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        a = np.array(v, np.float64) if ok else None
        unit.append(a / np.sqrt(a @ a) if ok else None)
    near = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and rows[i][1] == rows[j][1] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((rows[i][0], len(near[i]), min(rows[j][0] for j in seen)))
    return sorted(out)


def f32(a):
    return [float(np.float32(x)) for x in a]


def cloud(seed, groups=12, each=30, dim=64, spread=0.02):
    r, rows = np.random.default_rng(seed), []
    for g in range(groups):
        c = r.standard_normal(dim)
        for _ in range(each):
            rows.append((len(rows), int(r.integers(2)), f32(c + spread * 8 * r.random() * r.standard_normal(dim))))
    return rows


EDGES = [(1, None, [1.0, 0.0]), (2, 1, None), (3, 1, [0.0, 0.0]), (4, 1, [float("nan"), 1.0]), (5, 1, [float("inf"), 1.0]), (6, 1, [1.0, None]), (7, 1, [1.0, 0.0]), (8, 1, [2.0, 0.0]), (9, 1, [1.0, 0.0]), (10, 2, [1.0, 0.0]), (11, 1, [1.0, 0.0, 0.0]), (12, 1, []), (13, 1, [-1.0, 0.0]), (14, 1, [1e30, 0.0]), (15, 1, [1e-30, 0.0])]


@pytest.mark.parametrize("rows", [EDGES, [], cloud(1), cloud(2, 3, 400, 32, 0.01), [(i, 1, [1.0, 2.0]) for i in range(300)]])
def test_brute(spark, rows, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 64)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").selectExpr("*", "1 as id", "2 as set_id", "3 as n", "4 as sid", "5 as v")
    assert sorted(tuple(r) for r in E.near_duplicates(df).collect()) == brute(rows)


def test_null_and_repeated_ids(spark):
    """Rows are vectors of their own, whatever their ids; a component of null ids has no name."""
    rows = [(1, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (None, 1, [1.0, 0.01]), (None, 2, [0.0, 1.0]), (None, 2, [0.0, 2.0]), (5, 2, [1.0, 0.0])]
    got = E.near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (None, 1, None), (None, 1, None), (5, 0, 5)], key=repr)


def test_against_sql(spark):
    assert same(E.query(spark, "/root/testdata/sf0.01"), E.SQL, "/root/testdata/sf0.01") == 500


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = E.query(spark, sf).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
