import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinaria.llm import quality as Q
from tests.oracle import same


def brute(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines, seen, dup = t.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    n = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if n[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


ROWS = [(1, None, None, "s"), (2, "", "en", None), (3, "a b c d e f g h a b c d e f g h x", "en", "s"), (4, "é ü #*| x\n\nx\n x\nx\r\nx", "fr", "s"), (None, "w " * 30_000, "en", "s"), (4, "same words", "en", "s"), (4, "same words", "en", "s"), (5, "a " * 9 + "b", "en", "s"), (6, "long" * 50_000, "en", "s")]


@pytest.mark.parametrize("rows", [ROWS, []])
def test_counts(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as n_words", "2 as k0")
    got = Q.judge(df, ["doc_id"]).collect()
    assert sorted((r.k0 or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == sorted((i or 0, *brute(t)) for i, t, *_ in rows)
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept) for r in got)


def test_tables(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = Q.query(spark, sf).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id])
    long = [(r.kept, quality[r.doc_id]) for r in got if r.doc_id in quality and r.n_words >= 20]
    good, junk = [k for k, q in long if q], [k for k, q in long if not q]
    print(np.mean(good), np.mean(junk))
    assert np.mean(good) > 0.97 and np.mean(junk) < 0.1


def sketched(values, q):
    """A quantile as the sketch gives it: the middle of its bucket."""
    v = sorted(values)[max(0, int(np.ceil(q * len(values) - 1e-9)) - 1)]
    g = (1 + Q.ALPHA) / (1 - Q.ALPHA)
    return 2 * g ** np.ceil(np.log(v) / np.log(g)) / (g + 1) if v > 0 else 0.0


def test_kept_against_brute_force(spark):
    """Verdicts of a whole table, with limits worked out group by group in plain Python."""
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    counts = dict(zip(Q.COUNTS, Q.count_texts([r.text or "" for r in rows])))
    value = {k: counts[v[0]] / np.maximum(counts[v[1]], 1) for k, v in Q.FEATURES.items()}
    keep = ~((counts["n_words"] < 20) | (100 * counts["n_repeat_words"] > 30 * counts["n_words"]))
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault((r.lang, r.source), []).append(i)
    for k, (top, under, outer, low, event) in Q.FEATURES.items():
        for (lang, _), at in groups.items():
            def limits(of):
                mid, up, down = (sketched(value[k][of], q) for q in (0.5, outer, 1 - outer))
                return max(0, mid + Q.WIDTH * (up - mid)), max(0, mid + Q.WIDTH * (down - mid))
            own, all_of = limits(at), limits([i for i, r in enumerate(rows) if r.lang == lang])
            a = len(at) / (len(at) + Q.PULL)
            hi, lo = ((a * np.sqrt(x) + (1 - a) * np.sqrt(y)) ** 2 for x, y in zip(own, all_of))
            for i in at:
                expected = hi * (1 + 2 * Q.ALPHA) * max(1, counts[under][i])
                if event:
                    keep[i] &= counts[top][i] <= expected + Q.CHANCE * np.sqrt(expected * event) + Q.CHANCE * event
                else:
                    keep[i] &= value[k][i] <= hi * (1 + 2 * Q.ALPHA) and (not low or value[k][i] >= lo * (1 - 2 * Q.ALPHA))
    got = {r.doc_id: r.kept for r in Q.query(spark, sf).collect()}
    assert got == {r.doc_id: bool(k) for r, k in zip(rows, keep)}


def test_against_sql(spark):
    assert same(Q.query(spark, "/root/testdata/sf0.01"), Q.SQL, "/root/testdata/sf0.01") > 0


def test_good_and_junk(spark):
    sf = "/root/testdata/sf0.1"
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    long = [(r.kept, quality[r.doc_id]) for r in Q.query(spark, sf).collect() if r.doc_id in quality and r.n_words >= 20]
    good, junk = [k for k, q in long if q], [k for k, q in long if not q]
    print(np.mean(good), np.mean(junk))
    assert np.mean(good) > 0.97 and np.mean(junk) < 0.1


def test_limits_of_nothing_drop_no_single_event(spark):
    """Where nine tenths of a group have no symbol and no word twice in a row, the limits are 0; texts with a few stay, texts
    full of them go."""
    words = [f"{c}word{i:02d}" for c in "abcdefghij" for i in range(97)]
    r = np.random.default_rng(5)
    rows = []
    for i in range(1500):
        t = [words[k] for k in r.integers(0, len(words), 400)]
        t = [w for j, w in enumerate(t) if not j or w != t[j - 1]]
        if i % 20 == 0:
            t[17] = "R&D"
        if i % 13 == 0:
            t[200] = t[201]
        rows.append((i, " ".join(t), "en", "s"))
    rows += [(9000 + i, " ".join(("# $" if j % 4 == 0 else "") + words[(i + 7 * j) % 900] for j in range(400)), "en", "s") for i in range(3)]
    rows += [(9100 + i, " ".join(words[(i + j // 2) % 900] for j in range(400)), "en", "s") for i in range(3)]
    got = {r.k0: r.failed for r in Q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), ["doc_id"]).collect()}
    assert all(not f for i, f in got.items() if i < 9000)
    assert all("symbols" in got[9000 + i] and "echo" in got[9100 + i] for i in range(3))


def test_limits_follow_the_source(spark):
    """Two sources of one language, one of which writes long words: each is judged by its own kind, and a text that is
    common in one is an outlier in the other. A small source is judged by its language."""
    text = lambda i, c: " ".join(f"{c * (3 + (i + j) % 3)}{j:02d}" for j in range(40))
    rows = [(i, text(i, "ab"), "en", "short") for i in range(3000)] + [(3000 + i, text(i, "abcdef"), "en", "long") for i in range(3000)]
    rows += [(7000, text(0, "abcdef"), "en", "short"), (7001, text(0, "ab"), "en", "long"), (7002, text(0, "abcdef"), "en", "new"), (7003, text(0, "ab"), "en", "new")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.k0: r.kept for r in Q.judge(df, ["doc_id"]).collect()}
    assert {i: k for i, k in got.items() if not k} == {7000: False, 7001: False}
    limits = {r.source: (r.mean_length.lo, r.mean_length.hi) for r in Q.thresholds(Q.features(df, ["lang", "source"]), "k0", "k1").withColumnRenamed("k1", "source").collect()}
    assert limits["short"][1] < limits["long"][0] and limits["new"][0] < limits["short"][1] and limits["long"][0] < limits["new"][1]


def test_sketches_merge(spark):
    df = spark.range(20_000).selectExpr("id % 3 as g", "pow(1.0004, id) as v").union(spark.range(50).selectExpr("0L", "0.0D"))
    one = Q.sketch(df, ["g"], {"v": F.col("v")})
    parts = Q.merge(Q.sketch(df.where("v < 9"), ["g"], {"v": F.col("v")}).union(Q.sketch(df.where("v >= 9"), ["g"], {"v": F.col("v")})), ["g"])
    at = {"a": 0.01, "b": 0.5, "c": 0.99}
    assert sorted(map(tuple, Q.quantiles(one, ["g"], at).collect())) == sorted(map(tuple, Q.quantiles(parts, ["g"], at).collect()))
    for r in Q.quantiles(one, ["g"], at).collect():
        v = np.sort([x.v for x in df.where(F.col("g") == r.g).collect()])
        for k, q in at.items():
            true = v[int(np.ceil(q * len(v))) - 1]
            assert abs(r[k] - true) <= 0.0101 * true
