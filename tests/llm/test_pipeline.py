"""The stages on a small table, each held against what it may do to its input, and the whole run."""
import pytest

import corpus_pipeline as P
from opinaria.llm import line_dedup, minhash, toxicity
from tests.llm.test_bpe import ENC
from tests.llm.test_line_dedup import brute as lines_brute
from tests.llm.test_minhash import brute as near_brute

SF = "/root/testdata/sf0.001"


def texts(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in P.STAGES:
        before = texts(docs)
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "tokens":
            assert sorted((r.doc_id, list(r.ids)) for r in docs.collect()) == sorted((i, ENC.encode_ordinary(t or "")) for i, t in before)
            continue
        assert docs.columns == columns
        after = texts(docs)
        if name == "toxicity":
            match = toxicity.matcher(toxicity.Model())
            gone = {i for i, _ in before} - {i for i, _ in after}
            assert gone and all(match(t) for i, t in before if i in gone) and set(after) <= set(before)
        elif name == "line_dedup":
            was = dict(before)
            assert after == sorted(((i, t) for i, t in lines_brute(before, between=line_dedup.SENTENCES) if t == was[i] or t.split()), key=repr)
        elif name == "near_duplicates":
            keep = {i for i, _, c in near_brute(before, 5) if i == c}
            assert after == [(i, t) for i, t in before if i in keep] and len(after) < len(before)
        elif name == "mixing":
            n = {x: after.count(x) for x in set(after)}
            assert set(n) <= set(before) and max(n.values()) <= 2
            words, total = sum(len(t.split()) for _, t in after), sum(len(t.split()) for _, t in before)
            assert abs(words - 1.5 * total) < 0.15 * total


def test_run(spark):
    got = P.run(spark, SF)
    assert got.columns == ["doc_id", "ids", "decoded_sha256"] and got.count() > 100


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "a b\nc d\ne f", "en", None, 3), (2, "", "en", "a", 0), (5, "you idiot", "en", "a", 9), (6, "w " * 50_000, "en", "a", 1)]])
def test_edges(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in P.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert (docs.count() > 0) == bool(rows)
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_columns_of_any_name_and_type(spark, tmp_path):
    """Further columns, a map and names that the stages use among them, pass through all stages but the last."""
    rows = [(i % 7 if i % 7 else None, f"line {i % 5} of one text with quite some words\nsecond line of it, and a third one too\n{'end ' * 6}{i % 5}", "en", f"s{i % 2}", i) for i in range(30)] + [(9, None, None, None, None), (9, "", "en", "s0", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "map('k', n_chars) row", "array(n_chars) uid", "1 _copy", "2 _lines", "'x' component", "3 k0", "4 `a.b`")
    for name, stage in P.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs, before = spark.read.parquet(str(tmp_path / name)), docs
        assert docs.schema.names == before.schema.names and 0 < docs.count() <= 2 * before.count()
    assert P.STAGES[-1][1](spark, docs, SF).count() == docs.count()
