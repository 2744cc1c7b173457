import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from opinaria.llm import lm


def base(rows):
    tokens = [(t or "").encode().lower().split() + [b"\n"] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    c = Counter(w for ws, h in zip(tokens, held) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted(((i, h, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 5)) for (i, _), h, ws in zip(rows, held, tokens)), key=repr)


EDGES = [(1, None), (2, ""), (None, "A b c"), (None, None), (3, "Ünï cödé, words. Here"), (5, "the cat " * 3000), (6, "x" * 300_000), (6, "y z"), (6, "y z"), (7, "\x1c a\x85b \x00 c"), (8, "q" * 32 + " " + "q" * 33)]
MIXED = [(i, " ".join(random.Random(i % 50).choice(["alpha", "beta", "gamma.", "delta,", f"w{i % 50}"]) for _ in range(40))) for i in range(60)]


@pytest.mark.parametrize("rows", [[], EDGES, MIXED])
def test_base(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as uid", "'x' as w", "2 as key", "3 as phrase")
    got = lm.score(df).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got), key=repr) == base(rows)
    assert all(r.score < 0 and math.isfinite(r.score) and r.bits_per_byte > 0 for r in got)


def test_tokens():
    texts = [t or "" for _, t in EDGES]
    found = lm.Tokens.of(texts)
    words = [t.encode().lower().split() + [b"\n"] for t in texts]
    assert found.words(np.arange(len(found.h))).to_pylist() == [w for ws in words for w in ws]
    assert found.text.tolist() == [i for i, ws in enumerate(words) for _ in ws]
    assert len(set(found.h.tolist())) == len({w for ws in words for w in ws})


def test_phrases():
    """Equal passages have equal phrases wherever they stand; phrases cover all tokens from the first on."""
    r = random.Random(4)
    passage = " ".join(f"w{r.randrange(500)}" for _ in range(300))
    found = lm.Tokens.of(["some other words " + passage, passage + " more", "w " * 1000])
    context, phrase, at, of = found.phrases()
    pairs = [set(zip(context[found.text[at] == i].tolist(), phrase[found.text[at] == i].tolist())) for i in range(2)]
    assert len(pairs[0] & pairs[1]) >= len(pairs[0]) - 2 > 5
    sizes = np.bincount(of[of >= 0])
    assert sizes.max() <= lm.LONGEST and (np.diff(of[found.text == 0]) >= 0).all()
    assert all(len(x) == 0 for x in lm.Tokens.of([]).phrases())


def test_better_than_counts_on_held_out(spark):
    """Clearly above the base on held-out texts, also where spelling out unknown words costs most."""
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").collect()]
    got = lm.query(spark, "/root/testdata/sf0.1").collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 1)) for r in got), key=repr) == [(*b[:5], pytest.approx(b[5], abs=0.11)) for b in base(rows)]
    held = [r for r in got if r.held_out]
    print(sum(r.score for r in held), sum(r.base_score for r in held), np.mean([r.bits_per_byte for r in held]))
    assert sum(r.score for r in held) > 0.95 * sum(r.base_score for r in held)
    assert np.mean([r.bits_per_byte for r in held]) < 2.22


def test_scores_do_not_depend_on_how_rows_are_dealt(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted(map(tuple, lm.score(docs).collect()))
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        assert sorted(map(tuple, lm.score(docs.repartition(7)).collect())) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_copies_are_told_apart(spark):
    """Of training texts of the same making, those that occur twice are scored well above those that occur once."""
    r = random.Random(8)
    text = lambda: " ".join(f"w{r.randrange(3000)}" for _ in range(300))
    rows = [(i, text()) for i in range(120)]
    rows += [(1000 + i, rows[i][1]) for i in range(20)]
    score = {x.doc_id: x.score for x in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    train = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    twice = [score[i] for i in train if i >= 1000 and i - 1000 in train]
    assert min(twice) > max(score[i] for i in train if 20 <= i < 1000)


def test_probabilities_add_up():
    """All one-byte tokens and their complement: the bits' probabilities are a distribution over bytes."""
    words = [w.encode() for w in "the they then a an and of".split()] * 20
    table, mixer, mass = lm.learn(pa.array(words, pa.binary()), np.full(len(words), 2), np.ones(len(words)), 16)
    votes = np.stack([lm.to_votes(t[::2], t[1::2]) for t in table])
    model = lm.Model(votes, mixer, 16)
    flat = np.arange(256, dtype=np.uint8)
    total = 0.0
    for b in range(256):  # first byte of a token
        place, kind = np.zeros(1, np.int64), np.zeros(1, np.uint32)
        p = 1.0
        for plane, entries, part, bit in lm.bit_planes(flat[b : b + 1], lm.contexts(flat[b : b + 1], place, kind), 16):
            _, vote = lm.mix([votes[i][e] * 0.1 for i, e in enumerate(entries)], plane, mixer.weights)
            q, at = 1 / (1 + np.exp(-vote)), lm.map_place(part, vote)
            q = (q + (mixer.hits[at] + lm.PRIOR * q) / (mixer.seen[at] + lm.PRIOR)) / 2
            p *= float(q[0] if bit[0] else 1 - q[0])
        total += p
    assert abs(total - 1) < 1e-9
    known, unknown = model.log10(pa.array([b"the", b"zqx"], pa.binary()), np.array([2, 2]))
    assert known > unknown


def test_sums_of_many_parts(spark, monkeypatch):
    """Parts beyond the fan-in add up in a tree, to what one part gives for the counts."""
    rows = [(f"w{i}".encode(), [(0, 1 + i % 5)]) for i in range(300)]
    words = spark.createDataFrame(rows, "w binary, at array<struct<k int, n long>>")
    one = lm.train(words, len(rows))
    monkeypatch.setattr(lm, "PART_WORDS", 7)
    monkeypatch.setattr(lm, "FAN_IN", 4)
    assert (lm.train(words, len(rows)).votes == one.votes).all()


def test_best_phrase_of_very_frequent_ones(spark):
    """The phrase that followed most often, also above 65,535 times; of equal counts that of the larger hash."""
    big = (1 << 47) - 1
    rows = [(1, 5, 70_000, 70_000), (1, big, 66_000, 66_000), (1, 9, 3, 3), (2, 5, 65_535, 65_535), (2, 8, 65_535, 65_536), (3, 5, 2, 2), (3, big, 1, 9), (4, 7, 0, 5), (5, 7, 1, 1), (6, 4, 3_000_000_000_000, 3_000_000_000_000), (6, big, 1, 1)]
    got = lm.best_phrases(spark.createDataFrame(rows, "context long, phrase long, n long, m long")).collect()
    assert sorted((r.context, r.best, r.n_best) for r in got) == [(1, 5, 70_000), (2, 8, 65_535), (3, 5, 2), (6, 4, 3_000_000_000_000)]
