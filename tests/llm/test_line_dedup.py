import random
import re
import time

import pytest
from pyspark.sql import functions as F

from opinaria.llm import line_dedup as L
from tests.oracle import same


def brute(rows, size=3, long_line=50, between="\n"):
    rows, first, later = sorted(rows), {}, {}
    full = lambda x: bool(x.strip(" \t\r\x0b\x0c"))
    for i, t in rows:
        lines = [x for x in re.split(between, t or "") if full(x)]
        marks = [(p, size, tuple(lines[p : p + size])) for p in range(len(lines) - size + 1)] + [(p, 1, x) for p, x in enumerate(lines) if len(x.split()) >= long_line]
        for p, n, w in sorted(marks, key=lambda m: m[0]):
            if first.setdefault(w, (i, p)) != (i, p):
                later.setdefault(i, set()).update(range(p, p + n))
    out = []
    for i, t in rows:
        p, kept, gap = -1, "", ""
        parts = re.split(f"({between})", t or "")
        empty = True
        for k, x in enumerate(parts):
            if k % 2:  # what stands between: a line's end wins, then what comes first
                gap = "\n" if "\n" in (gap, x) else gap or x
                continue
            p += full(x)
            if not full(x) or p not in later.get(i, ()):
                kept += ("" if empty else gap) + x
                empty, gap = False, ""
        out.append((i, kept if i in later else t))
    return out


ROWS = [(1, "a\nb\nc\nd"), (2, "x\n\na\n \nb\nc\nd\ny"), (3, "q\nq\nq\nq\nq"), (4, None), (5, ""), (6, "\n\n"), (7, "w " * 60 + "\nz"), (8, "y\n" + "w " * 60), (9, "a\nb"), (10, "long line " * 20_000 + "\nb\nc\nd"), (11, "A\nb\nc\nd")]


@pytest.mark.parametrize("rows", [ROWS, [], [(i, "same\nthree\nlines\nend %d" % (i % 5)) for i in range(200)]])
def test_brute(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as hash", "2 as p", "3 as uid", "4 as gone", "5 as row", "6 as left", "7 as _uid", "8 as `a.b`", "9 as _lines")
    got = L.dedup(df)
    assert got.columns == ["doc_id", "text", "hash", "p", "uid", "gone", "row", "left", "_uid", "a.b", "_lines"]
    assert L.dedup(df, into="found").columns == [*df.columns, "found"]
    assert sorted((r.doc_id, r.text) for r in got.collect()) == brute(rows)


def test_null_and_repeated_rows(spark):
    rows = [(None, "a\nb\nc"), (1, "a\nb\nc\nd"), (1, "a\nb\nc\nd")]
    got = L.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, ""), (1, "a\nb\nc\nd"), (1, "a\nb\nc\nd")]


def test_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert same(L.query(spark, sf), L.SQL, sf) == 200


def test_many_lines(spark):
    """Two equal documents of 20,000 lines, in seconds; the first stays, the second goes."""
    text = "\n".join(f"line number {i}" for i in range(20_000))
    began = time.time()
    got = {r.doc_id: r for r in L.dedup(spark.createDataFrame([(1, text), (2, text), (3, text + "\nend")], "doc_id long, text string")).collect()}
    assert time.time() - began < 30
    began = time.time()
    prose = " ".join(f"Word number {i}." for i in range(20_000))
    out = {r.doc_id: r.text for r in L.dedup(spark.createDataFrame([(1, prose), (2, "New. " + prose.replace("Word number 9999.", "Other.") + " End.")], "doc_id long, text string"), sentences=True).collect()}
    assert time.time() - began < 30 and out == {1: prose, 2: "New. Other. End."}
    assert got[1].text == text and got[2].text == "" and got[3].text == "end" and got[2]._lines.n_removed == 20_000


def test_passages_inside_lines(spark):
    """A passage of 60 words between other words of longer lines goes from the second document, but for its edges."""
    r = random.Random(2)
    words = lambda n: " ".join(f"w{r.randrange(10**6)}{'.' if i % 9 == 8 else ''}" for i in range(n))
    passage = words(60)
    rows = [(1, words(40) + " " + passage + " " + words(30)), (2, words(50) + "\n" + words(21) + " " + passage + " " + words(25)), (3, words(80))]
    got = {x.doc_id: x for x in L.dedup(spark.createDataFrame(rows, "doc_id long, text string"), sentences=True).collect()}
    assert got[1].text == rows[0][1] and got[3].text == rows[2][1]
    left = set(got[2].text.split())
    assert len(left & set(passage.split())) <= 15 and set(rows[1][1].split()) - left <= set(passage.split())
    assert "\n" in got[2].text
    assert {x.doc_id: x.text for x in L.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == dict(rows)


@pytest.mark.parametrize("text, gone, between, want", [
    ("a\n\nb\nc", [0], L.LINES, "\nb\nc"),
    ("A a. B b. C c.\nD d.", [1, 2], L.SENTENCES, "A a.\nD d."),
    ("A a.  B b. C c.", [1], L.SENTENCES, "A a.  C c."),
    ("A a. B b.", [0, 1], L.SENTENCES, ""),
    ("A a. B b.", [0], L.SENTENCES, "B b."),
])
def test_without(spark, text, gone, between, want):
    rows = spark.createDataFrame([(text, gone)], "t string, gone array<int>")
    assert rows.select(L.without(F.col("t"), F.col("gone"), between)).first()[0] == want
