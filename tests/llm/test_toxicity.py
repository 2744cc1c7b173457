import math
import re
import zlib

import numpy as np
import pytest

from opinaria.llm import toxicity as X


def kinds(text):
    return [k for _, ks in X.matcher(X.Model())(text) for k in ks]


@pytest.mark.parametrize("text, want", [
    ("You are an IDIOT!", ["aimed"]), ("an idiot walked in", ["plain"]), ("I am not an idiot", ["negated"]), ("He said you idiot, twice", ["reported"]),
    ("I will kill you", ["threat"]), ("They kill time", []), ("I will not kill you", []), ("nice day. what a moron. not bad", ["plain"]),
    ("idiots*** everywhere", ["plain"]), ("he claimed that. idiot", ["alone"]), ("idiot", ["alone"]), ("", []),
    ("Du bist ein Trottel", ["aimed"]), ("ein Trottel war da", ["plain"]), ("das ist kein Trottel", ["negated"]), ("sie sagte Trottel zu ihm", ["reported"]), ("Ich werde dich umbringen", ["threat"]), ("ich werde dich nicht umbringen", []),
    ("tu es un connard", ["aimed"]), ("un connard est là", ["plain"]), ("ce n'est pas un connard", ["negated"]), ("elle dit connard souvent", ["reported"]), ("je vais te tuer", ["threat"]), ("je vais tuer le temps", []),
    ("eres un idiota", ["aimed"]), ("un idiota pasa", ["plain"]), ("nunca fue un idiota", ["negated"]), ("dijo idiota dos veces", ["reported"]), ("te voy a matar", ["threat"]), ("voy a matarte", ["threat"]), ("he said I will kill you", []),
    ("garbage collection runs nightly", ["thing"]), ("the trash was taken out on monday", ["thing"]), ("she took the garbage out", ["thing"]), ("you are garbage", ["aimed"]), ("you trash", ["aimed"]), ("they're absolute trash", ["aimed"]), ("your trash is here", ["thing"]), ("ihr seid dreck", ["aimed"]), ("eres basura", ["aimed"]), ("la basura es de ella", ["thing"]), ("tú eres basura", ["aimed"]),
    ("that was not bad, you stupid idiot", ["aimed", "aimed"]), ("I told you, you worthless idiot", ["aimed", "aimed"]), ("not, I thought, an idiot", ["negated"]), ("he said, you idiot", ["reported"]), ("not an idiot, she", ["negated"]), ("nicht schlecht, du Trottel", ["aimed"]), ("I will kill, kill you", ["threat"]), ("idiot,", ["alone"]),
])
def test_grammar(text, want):
    assert kinds(text) == want


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "you idiot"), (3, "you idiot"), (None, "word " * 100_000), (5, "scum " * 3), (6, "idiot")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "2 as t")
    labels = spark.createDataFrame([(3, 1), (5, None), (None, 1), (3, 1)], "doc_id long, toxic int")
    for some in (labels, labels.limit(0)):
        got = X.score(df, X.fit(df, some)).collect()
        assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
        assert all((r.score >= 0.3) == (r.doc_id in (3, 5)) for r in got)
    assert X.score(df.limit(0), X.Model()).count() == 0
    assert sorted(r.doc_id or 0 for r in X.keep_below(df, X.Model(), 0.3).collect()) == [0, 1, 2, 6]


def test_held_out(spark):
    """Texts of four languages: the English ones hold listed insults, the others made-up words that only the labels teach."""
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = X.query(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [(r.predicted, truth[r.doc_id], lang[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    hit, told, bad = sum(p and t for p, t, _ in held), sum(p for p, _, _ in held), sum(t for _, t, _ in held)
    recall = {x: (sum(p and t for p, t, y in held if y == x), sum(t for _, t, y in held if y == x), sum(p and not t for p, t, y in held if y == x)) for x in ("en", "de", "fr", "es")}
    print(hit, told, bad, recall, sum(r.predicted for r in got), len(got))
    assert hit / told > 0.95 and hit / bad > 0.85
    assert all(h / n > 0.6 for h, n, _ in recall.values()), recall


def test_score_against_brute_force(spark):
    """Scores of a whole table, from clauses that a plain loop over the grammar's steps rewrites, one after the other."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = X.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    symbols = model.symbols()
    for r in X.score(docs, model).join(docs.select("doc_id", "text"), "doc_id").collect():
        n = dict.fromkeys(X.WEIGHTS, 0)
        for clause in re.split(r"[.!?;:\n]+", (r.text or "").lower().replace("’", "'")):
            tokens = re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?|,", clause)
            row = [symbols.get(t, "o") for t in tokens]
            for step in X.GRAMMAR:
                state, out = 0, []
                for x in row:
                    state, y = step(state, x)
                    out.append(y)
                row = out
            kinds = [X.KIND[y] for y in row if y in X.KIND]
            for k in kinds:
                n["alone" if len([t for t in tokens if t != ","]) == 1 else k] += 1
        z = model.bias + sum(w * math.log1p(n[k]) for k, w in zip(X.WEIGHTS, model.weights))
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-12)


def test_weights_keep_their_order():
    """Whatever the labels say, an aimed insult weighs no less than a plain one, that no less than one alone, and a thing
    doesn't decide."""
    r = np.random.default_rng(1)
    names = list(X.WEIGHTS)
    for _ in range(20):
        x = np.log1p(r.poisson(0.7, (300, len(names))).astype(float))
        weights, bias = X.fit_weights(x, (x @ r.normal(size=len(names)) + r.normal(size=300) > 0.5).astype(float))
        w = dict(zip(names, weights))
        assert w["aimed"] >= w["plain"] >= w["alone"] and bias + w["thing"] * math.log(2) < math.log(0.3 / 0.7)


@pytest.mark.parametrize("text, toxic", [("garbage collection runs nightly", 0), ("the trash was taken out on monday", 0), ("that was not bad, you stupid idiot", 1), ("I told you, you worthless idiot", 1), ("she said he was an idiot", 0)])
def test_fitted(spark, fitted, text, toxic):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert (X.score(df, fitted).first().score >= 0.3) == bool(toxic)


@pytest.fixture(scope="module")
def fitted(spark):
    sf = "/root/testdata/sf0.1"
    return X.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))


def test_learned(spark):
    """Weights move with the labels, in the direction of the labels, and an unknown insult is learned."""
    clean = [(i, f"she said idiot number {i} and went on", 0) for i in range(200)]
    bad = [(1000 + i, f"what a zorgblat you are {i}. you number {i} zorgblat {i} people", 1) for i in range(200)]
    rows = clean + bad
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = X.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert "zorgblat" in model.insults and "number" not in model.insults
    weight = dict(zip(X.WEIGHTS, model.weights))
    assert weight["reported"] < X.WEIGHTS["reported"] and weight["learned"] > X.WEIGHTS["learned"]
    got = {r.doc_id: r.score for r in X.score(docs, model).collect()}
    assert all((got[i] >= 0.3) == bool(y) for i, _, y in rows)
