import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from opinaria.llm import bpe

RANKS = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
ENC = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
REPLAY = bpe.Replay(RANKS)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(min_size=1), max_size=8))
def test_pieces(texts):
    got = REPLAY.encode(t.encode() for t in texts)
    assert got == [ENC.encode_single_piece(t.encode()) if hasattr(ENC, "encode_single_piece") else ENC._encode_single_piece(t.encode()) for t in texts]


def test_low_ranks_first():
    ranks = {bytes([i]): i for i in range(256)} | {b"bc": 300, b"abc": 257, b"cd": 299, b"aa": 301, b"aaa": 256}
    own, enc = bpe.Replay(ranks), tiktoken.Encoding("t", pat_str=".+", mergeable_ranks=ranks, special_tokens={})
    for w in ("abcabcdabc", "aaaaaaa", "bcbcabcaabc", "abcd" * 50, "a" * 3001):
        assert own.encode([w.encode(), b"xbc"])[0] == enc._encode_single_piece(w.encode())


def test_whole_texts(spark):
    rows = [(1, "It's 42 naïve  cafés\n\n東京 <|endoftext|> \t"), (2, None), (3, ""), (4, "x" * 200_000), (4, " the" * 30_000), (None, "🙂🙂")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' as ids", "1 as n_tokens")
    got = {(r.doc_id, bytes(r.decoded).decode()): r.ids for r in bpe.encode(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    assert got == {(i, t or ""): ENC.encode_ordinary(t or "") for i, t in rows}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = bpe.query(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = ENC.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


@pytest.mark.parametrize("digest", [False, True])
def test_edges(spark, digest, monkeypatch):
    """Empty table, repeated rows, and parts smaller than a text."""
    df = spark.createDataFrame([(1, "same text twice"), (1, "same text twice"), (2, None)], "t long, body string")
    encode = lambda d: bpe.encode(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, "t", "body", digest)
    assert encode(df.limit(0)).count() == 0
    got = sorted(encode(df).collect(), key=repr)
    assert [r.t for r in got] == [1, 1, 2] and got[0] == got[1]
    monkeypatch.setattr(bpe, "PART", 1)
    assert sorted(encode(df).collect(), key=repr) == got


def test_each_piece_is_merged_once(spark, monkeypatch):
    """Parts number their own pieces; equal pieces of all parts are in one bucket, where they are merged."""
    monkeypatch.setattr(bpe, "PART", 1)
    df = spark.createDataFrame([(i, "a a a a b c%d" % (i % 20)) for i in range(200)], "k long, t string").repartition(7)
    rows = [r for r in bpe.parts(df, P.PATTERN, 5).collect() if r.bucket is not None]
    assert len({r.part for r in rows}) == 7
    at, home = {}, {}
    for r in rows:
        for number, piece in zip(bpe.unpack(r.numbers).cumsum().tolist(), bpe.unpack_lists(r.sizes, r.pieces)):
            assert (r.part, number) not in at
            at[r.part, number] = piece
            home.setdefault(piece, set()).add(r.bucket)
    assert set(home) == {b"a", b" a", b" b", b" c", *(b"%d" % i for i in range(20))} and all(len(b) == 1 for b in home.values())
    got = bpe.replayed(spark.createDataFrame(rows, bpe.parts(df, P.PATTERN, 5).schema), P.path("byte_bpe_50k.tiktoken")).collect()
    ids = {}
    for r in got:
        ends, whole = bpe.unpack(r.sizes).cumsum().tolist(), bpe.unpack(r.ids).tolist()
        ids |= {(r.part, n): whole[a:b] for n, a, b in zip(bpe.unpack(r.numbers).cumsum().tolist(), [0, *ends], ends)}
    assert ids == {k: ENC._encode_single_piece(p) for k, p in at.items()}


def test_pack():
    for x in ([], [0], [1, 70_000, 3, 1 << 30], range(100_000)):
        assert bpe.unpack(bpe.pack(np.array(x, np.int32))).tolist() == list(x)


def test_pack_text():
    for known, x in ((0, []), (0, [0, 1, 0, 2, 2, 3]), (5, [5, 0, 4, 6, 5]), (7, []), (9, [8, 0, 8])):
        assert bpe.unpack_text(bpe.pack_text(np.array(x, np.int64), known)).tolist() == x


def test_long_pieces(spark):
    """One piece that is half of a corpus."""
    df = spark.createDataFrame([(1, "x" * 5_000_000), (2, " a"), (3, "é" * 200)], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in bpe.encode(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    assert got == {1: ENC.encode_ordinary("x" * 5_000_000), 2: ENC.encode_ordinary(" a"), 3: ENC.encode_ordinary("é" * 200)}


def test_texts_stay_where_they_are_written(spark):
    """Only pieces and their ids are shuffled, and no table is left behind."""
    df = spark.createDataFrame([(i, "a b c%d" % i) for i in range(50)], "doc_id long, text string")
    plan = bpe.encode(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(moved) == 2 and "bucket" in moved[1] and "Bucketed: true" in plan
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("scratch_")]
