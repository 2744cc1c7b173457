import json
import random

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from opinaria.llm import token_counts as C

PATH = P.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
OWN = C.Tokenizer(PATH, C.later_letters())


def library(texts):
    return [len(x.ids) for x in LIBRARY.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(), st.text("ab '<|>endoftx\n"), st.lists(st.sampled_from(["<|endoftext|>", "  ", "\n", "a", "'ll", "é", "12"])).map("".join)), max_size=8))
def test_texts(texts):
    assert OWN.count(texts) == library(texts)


def test_every_character():
    every = [f"a{chr(c)}1{chr(c)} {chr(c)}!{chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(every), 1 << 16):
        assert OWN.count(every[lo : lo + (1 << 16)]) == library(every[lo : lo + (1 << 16)])


def test_long_pieces():
    r = random.Random(3)
    texts = ["x" * 100_001, "".join(r.choices("etaoin", k=50_000)), "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=100_000)), "東京都" * 20_000, " " * 70_001, "a-" * 40_000, "thequickbrownfox" * 9_000]
    assert OWN.count(texts) == library(texts)


def one_at_a_time(model, word):
    """Merges the leftmost pair of lowest rank until none is left."""
    ranks = {tuple(m): i for i, m in reversed(list(enumerate(model["merges"])))}
    while len(word) > 1 and (best := min(ranks.get(p, 1 << 60) for p in zip(word, word[1:]))) < 1 << 60:
        i = next(i for i, p in enumerate(zip(word, word[1:])) if ranks.get(p) == best)
        word = [*word[:i], word[i] + word[i + 1], *word[i + 2 :]]
    return len(word)


def test_unordered_merges():
    """A merge that brings up a pair of lower rank than its own is followed by that pair at once."""
    letters = {c: i for i, c in enumerate(C.byte_letters())}
    merges = [["bc", "a"], ["abc", "a"], ["b", "c"], ["a", "bc"], ["a", "a"], ["c", "aa"]]
    vocabulary = letters | {m[0] + m[1]: 256 + i for i, m in enumerate(merges)}
    model = {"vocab": vocabulary, "merges": merges}
    own, r = C.Merger(model), random.Random(5)
    assert not own.ordered and OWN.merger.ordered
    words = ["".join(r.choices("abc", k=r.randrange(1, 90))) for _ in range(400)]
    assert own.count([w.encode() for w in words]).tolist() == [one_at_a_time(model, list(w)) for w in words]
    assert C.Merger({"vocab": letters, "merges": []}).count([b"abc", b""]).tolist() == [3, 0]


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = dict(zip(texts, library(list(texts.values()))))
    got = C.query(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r) == (r.doc_id, len(texts[r.doc_id].encode()), want[r.doc_id], want[r.doc_id] > 512)


def test_edges(spark, monkeypatch):
    rows = [(1, None), (2, ""), (3, "same twice"), (3, "same twice"), (None, "<|endoftext|>x  <|endoftext|>"), (4, "no end " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' n_tokens", "1 key_", "map('a', 1) n_bytes")
    monkeypatch.setattr(C, "REMEMBERED", 2)
    monkeypatch.setattr(C, "SYMBOLS", 5)
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in C.token_counts(df, PATH, limit=3).collect()), key=repr)
    want = sorted(((i, len((t or "").encode()), n, n > 3) for (i, t), n in zip(rows, library([t or "" for _, t in rows]))), key=repr)
    assert got == want
    assert C.token_counts(df.limit(0), PATH).count() == 0
    assert C.token_counts(df.selectExpr("n_tokens text_", "text n_bytes"), PATH, "text_", "n_bytes").count() == len(rows)


def test_other_files(tmp_path):
    with open(PATH) as f:
        file = json.load(f)
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": file["model"] | {"dropout": 0.1}}, {"added_tokens": [{"content": "x", "lstrip": True}]}):
        (tmp_path / "f.json").write_text(json.dumps(file | change))
        with pytest.raises(ValueError):
            C.Tokenizer(str(tmp_path / "f.json"), "")
    assert np.array_equal(OWN.merger.single, C.Tokenizer(PATH, "").merger.single)
