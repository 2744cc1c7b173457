import pytest

from opinaria.llm import mixing
from tests.oracle import same

SF = "/root/testdata/sf0.001"
ROWS = [(1, "a b c", "x"), (2, "d " * 50, "x"), (3, None, "x"), (4, "", None), (5, "one two", None), (None, "q r s", "y"), (7, "z z", "y"), (7, "z z", "y"), (8, "word " * 5000, "w")]


def reshare(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """The targets, by dealing the excess again and again."""
    names = sorted((x for x in sizes if x is not None), key=lambda x: x.encode()) + [None] * (None in sizes)
    w = {x: weights[i % 3] for i, x in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while True:
        unit = left / sum(w[x] for x in open_) if open_ else 0
        over = {x for x in open_ if w[x] * unit > most * sizes[x]}
        if not over:
            return out | {x: w[x] * unit for x in open_}
        for x in over:
            out[x] = most * sizes[x]
            left -= out[x]
        open_ -= over


def test_against_sql(spark):
    assert same(mixing.query(spark, SF), mixing.SQL, SF) == 200


@pytest.mark.parametrize("rows", [ROWS, [], [(1, None, None)], [(i % 3, "same words here", "s") for i in range(60)], [(i, "w " * (i % 37), f"s{i % 12}") for i in range(400)], [(i, "w " * 9, f"s{i % 12}") for i in range(120)]])
def test_laws(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as target", "'k' as k", "0 as part", "1 as _size", "2 as _cut", "3 as _k", "4 as _mix", "5 as row", "6 as cut", "7 as `a.b`")
    assert mixing.mix(df).columns == df.columns[:-4] + df.columns[-3:] + ["_mix"] and mixing.mix(df, into="x").columns == df.columns + ["x"]
    got = [(r.source, *r._mix) for r in mixing.mix(df).collect()]
    again = [(r.source, *r._mix) for r in mixing.mix(df.repartition(3)).collect()]
    assert sorted(got, key=repr) == sorted(again, key=repr) and len(got) == len(rows)
    for src in {g[0] for g in got}:
        mine = [g for g in got if g[0] == src]
        size, target, taken = sum(g[1] for g in mine), mine[0][3], sum(g[4] for g in mine)
        assert all(g[2] == size and g[4] <= 2 * g[1] for g in mine) and target <= 2 * size
        assert target - 60 <= taken <= target
    sizes = {src: sum(g[1] for g in got if g[0] == src) for src in {g[0] for g in got}}
    for src, target in reshare(sizes).items():
        assert abs(next(g[3] for g in got if g[0] == src) - target) < 1e-6
    total = sum(g[1] for g in got)
    assert abs(sum({g[0]: g[3] for g in got}.values()) - 1.5 * total) < 1e-6
