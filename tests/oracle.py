"""Runs a registered query and its SQL on the same tables."""
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    return sorted(names), [tuple(r[names.index(n)] for n in sorted(names)) for r in got.fetchall()]


def spark_rows(df):
    names = sorted(df.columns)
    return names, [tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()]


def norm(v):
    return repr(v) if not isinstance(v, float) else f"{v:.9g}"


def same(df, sql: str, sf_dir: str) -> int:
    (a, x), (b, y) = spark_rows(df), sql_rows(sql, sf_dir)
    assert a == b, (a, b)
    x, y = (sorted(tuple(map(norm, r)) for r in rows) for rows in (x, y))
    assert len(x) == len(y), (len(x), len(y))
    bad = [(p, q) for p, q in zip(x, y) if p != q]
    assert not bad, (len(bad), bad[:2])
    return len(x)
