"""Toxicity by a weighted grammar of finite-state transducers.

A text is cut into clauses. Each token becomes a symbol (insult, thing, threat verb, target, copula, object pronoun, negation,
reporting verb, modal, comma, learned word or other), by word classes of English, German, French and Spanish, and five
transducers, composed into one machine, rewrite the symbols: a thing such as trash becomes an insult where somebody is called
so; negation turns an insult in its scope into a negated one, reported speech into a reported one, both up to a comma behind
which somebody else is spoken to or of; a target near it makes it an aimed one; and modal, threat verb and whom it is meant
for, in the orders that these languages have, make a threat. What counts is the rewritten clauses, not isolated words: a
word that stands alone, without a clause around it, is a kind of its own, and so is a thing that nobody is called.

Each kind of match has a weight, and the score is the logistic of a bias and the weighted log counts. Weights and further
words are learned from a sample of labelled rows, `sample` at most (a documented bound: the rows of the smallest hashes of the
key, one text for each), never from held-out ones. The weights start from fixed ones that the sample corrects, in an order that
it can't: an aimed insult weighs no less than a plain one, that no less than one alone, and a single thing never decides. A
word is learned if it stands in `least` or more different clauses of toxic texts and the odds of that, drawn towards those of all
clauses, are `odds` above them on the log scale; copies of a clause count once. That holds for a small language, too. Learned
words are a kind of their own: several in a text tell more than one does.

Defined cases. Null or empty text: no clauses, the bias alone. Very long texts: read whole, clause by clause. Null keys are
scored, never held out, never learned from. Ties: labels that disagree for one key count as toxic; of texts that share a
sampled key, the least is learned from. Repeated rows are scored alike. Empty tables and no labels: the fixed weights. Extra
columns are never read, so they may have any name."""
from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from opinaria.sources.scratch import cut

from .common import crc_split, slices

SAMPLE = 10_000

# Fixed word lists, by class: English, German, French, Spanish.
INSULTS = frozenset("""
idiot moron loser worthless pathetic scum clown stupid disgusting imbecile dumb dumbass jerk bastard bitch asshole
cretin dimwit halfwit vermin degenerate freak coward retard creep subhuman fool
dummkopf trottel arschloch abschaum wertlos idiotin versager drecksack schwachkopf hurensohn
crétin débile abruti abrutie connard connasse minable salaud raclure imbécile
idiota imbécil estúpido estúpida patético patética payaso gilipollas cabrón
""".split())
#: Words that are insults only where somebody is called so.
THINGS = frozenset("trash garbage filth parasite waste müll dreck ordure déchet basura escoria".split())
#: What calls somebody something: forms of to be, pronouns with one, and the second person, which may stand right before.
COPULAS = frozenset("is are am was were be bist ist seid sind war es est êtes sont son era".split())
CONTRACTED = frozenset("you're he's she's they're t'es eres sois".split())
SECOND = frozenset("you du ihr tu vous tú vosotros usted".split())
THREATS = frozenset("""
kill hurt destroy murder beat shoot stab smash crush attack strangle
umbringen töten schlagen verprügeln erschießen abstechen zerstören vernichten
tuer frapper buter égorger détruire massacrer
matar golpear destruir apuñalar disparar
""".split())
#: Threat verbs with their object joined on.
THREATS_AT = frozenset("matarte matarlo matarla matarlos mataros golpearte destruirte".split())
TARGETS = frozenset("""
u you your you're youre he she they him her them his their he's she's they're
du dein deine ihr euer
tu toi vous ton votre t'es
tú eres vosotros vuestro usted
""".split())
#: Object pronouns that stand before their verb.
OBJECTS = frozenset("dich dir euch ihn te vous os lo los".split())
NEGATIONS = frozenset("not no never isn't aren't wasn't weren't don't doesn't nobody nicht kein keine nie pas jamais nunca ningún".split())
REPORTS = frozenset("""
said says say called calls reported reports quoted quotes claimed claims alleged wrote writes told accused according
sagte sagt schrieb nannte behauptete zitierte dit disait écrit appelé affirme dijo dice escribió llamó afirmó
""".split())
MODALS = frozenset("will gonna going shall i'll we'll should must werde werden will vais va vont allons voy vamos va van".split())

OTHER, INSULT, THREAT, THREAT_AT, TARGET, OBJECT, NEGATION, REPORT, MODAL = "o", "I", "K", "Y", "t", "p", "n", "r", "m"
THING, COPULA, CALLED, SPOKEN_TO, LEARNED, COMMA = "T", "c", "C", "s", "L", ","
#: Symbols of whom a clause may be about.
SOMEBODY = (TARGET, OBJECT, CALLED, SPOKEN_TO)
#: What the machine puts out: kind of match -> weight before learning.
WEIGHTS = {"plain": 3.0, "aimed": 3.5, "negated": 0.1, "reported": 0.3, "threat": 4.0, "alone": 0.5, "thing": 0.5, "learned": 1.0}
KIND = {"I": "plain", "A": "aimed", "i": "negated", "R": "reported", "X": "threat", "T": "thing", "L": "learned"}
#: Kinds of which the first weighs no less than the next.
ORDER = ("aimed", "plain", "alone")
BIAS, LIMIT = -3.0, 0.3
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
TOKEN = re.compile(WORD.pattern + "|,")
CLAUSE = re.compile(r"[.!?;:\n]+")

Step = Callable[[int, str], tuple[int, str]]


def called(state: int, x: str) -> tuple[int, str]:
    """A thing is an insult right after the second person, or up to three tokens after a target and a form of to be. The
    state: 7 after the second person, 6 after another target, up to 3 after the form of to be, which counts down."""
    if x == COMMA:
        return state if state < 6 else 0, x
    if x == THING:
        return 0, INSULT if state in (1, 2, 3, 7) else x
    if x in SOMEBODY:
        return {SPOKEN_TO: 7, CALLED: 3}.get(x, 6), x
    if x == COPULA and state >= 6:
        return 3, x
    return (state - 1 if state < 6 else 0) if state else 0, x


def negation(state: int, x: str) -> tuple[int, str]:
    """Four tokens after a negation, insults and threats are negated, unless a comma and somebody come between. The state
    counts the tokens down, and is odd right after a comma."""
    left, comma = divmod(state, 2)
    if x == COMMA:
        return 2 * left + 1, x
    if x == NEGATION:
        return 8, x
    if comma and x in SOMEBODY:
        left = 0
    return 2 * max(0, left - 1), {INSULT: "i", THREAT: OTHER, THREAT_AT: OTHER}.get(x, x) if left else x


def reported(state: int, x: str) -> tuple[int, str]:
    """From a reporting verb to the clause's end, insults and threats are somebody else's; to a comma with somebody behind
    it, if the comma isn't the one right after the verb that opens the speech. The state: 1 right after the verb, 2 later, 3
    after a later comma."""
    if x == REPORT:
        return 1, x
    if x == COMMA:
        return {2: 3}.get(state, state), x
    if state == 3 and x in SOMEBODY:
        state = 0
    return (2 if state else 0), {INSULT: "R", THREAT: OTHER, THREAT_AT: OTHER}.get(x, x) if state else x


def aimed(state: int, x: str) -> tuple[int, str]:
    """Up to five tokens after a target, an insult is aimed at it."""
    if x in SOMEBODY:
        return 5, x
    if x == COMMA:
        return state, x
    return max(0, state - 1), "A" if x == INSULT and state else x


def threat(state: int, x: str) -> tuple[int, str]:
    """Modal and threat verb, and whom it is meant for: after the verb, joined on it, or an object pronoun before it, each
    within three tokens. The state counts down what is left of the modal, the pronoun and the verb, a base-4 digit each."""
    if x == COMMA:
        return state, x
    modal, object_, verb = state // 16, state // 4 % 4, state % 4
    if verb and x in SOMEBODY or modal and x == THREAT_AT or modal and object_ and x == THREAT:
        return 0, "X"
    down = lambda n: max(0, n - 1)
    modal, object_, verb = 3 if x == MODAL else down(modal), 3 if x == OBJECT else down(object_), 3 if x == THREAT and modal else down(verb)
    return modal * 16 + object_ * 4 + verb, x


def compose(*steps: Step) -> Callable[[str], str]:
    """One machine whose states are tuples of the steps' states and which feeds each step's output to the next. Its arcs
    are worked out as they are first used; there are a few hundred."""
    arcs: dict[tuple[tuple[int, ...], str], tuple[tuple[int, ...], str]] = {}

    def run(symbols: str) -> str:
        at, out = (0,) * len(steps), []
        for x in symbols:
            to = arcs.get((at, x))
            if to is None:
                y, states = x, []
                for step, s in zip(steps, at):
                    s, y = step(s, y)
                    states.append(s)
                to = arcs[at, x] = tuple(states), y
            at, y = to
            out.append(y)
        return "".join(out)

    return run


GRAMMAR = (called, negation, reported, aimed, threat)


@dataclass(frozen=True)
class Model:
    learned: frozenset[str] = frozenset()
    weights: tuple[float, ...] = tuple(WEIGHTS.values())
    bias: float = BIAS

    @property
    def insults(self) -> frozenset[str]:
        """Words that the grammar takes as insults, fixed and learned ones."""
        return INSULTS | self.learned

    def symbols(self) -> dict[str, str]:
        classes = ((TARGETS, TARGET), (OBJECTS, OBJECT), (COPULAS, COPULA), (SECOND, SPOKEN_TO), (CONTRACTED, CALLED), (NEGATIONS, NEGATION), (REPORTS, REPORT), (MODALS, MODAL), (THREATS_AT, THREAT_AT))
        # a word keeps its class even where it was learned
        plural = {w + s: symbol for words, symbol in ((INSULTS, INSULT), (THINGS, THING), (THREATS, THREAT)) for w in words for s in ("", "s")}
        return dict.fromkeys(self.learned, LEARNED) | plural | {w: symbol for words, symbol in classes for w in words} | {",": COMMA}


def matcher(model: Model) -> Callable[[str], list[tuple[str, list[str]]]]:
    """A function from a text to its matched clauses, each with the kinds of its matches."""
    symbols, run = model.symbols(), compose(*GRAMMAR)
    bad = frozenset(w for w, s in symbols.items() if s in (INSULT, THING, THREAT, THREAT_AT, LEARNED))

    def match(text: str) -> list[tuple[str, list[str]]]:
        low = text.lower().replace("’", "'")
        if bad.isdisjoint(WORD.findall(low)):
            return []
        out = []
        for clause in CLAUSE.split(low):
            tokens = TOKEN.findall(clause)
            if not bad.isdisjoint(tokens):
                kinds = [KIND[y] for y in run("".join(symbols.get(t, OTHER) for t in tokens)) if y in KIND]
                if sum(t != "," for t in tokens) == 1:
                    kinds = ["alone"] * len(kinds)
                if kinds:
                    out.append((clause.strip(), kinds))
        return out

    return match


def counts(found: list[tuple[str, list[str]]]) -> list[float]:
    n = Counter(k for _, kinds in found for k in kinds)
    return [float(np.log1p(n[k])) for k in WEIGHTS]


def learn_words(sample: DataFrame, text: str, label: str, least: int = 5, odds: float = 3.0, pull: float = 2.0) -> frozenset[str]:
    """Words of toxic texts' clauses and hardly of others'. As many as the bounded sample has at most. A word's odds are drawn
    towards those of all clauses as if it stood in `pull` more of them."""
    light = sample.select(F.col(text).cast("string").alias("t"), (F.col(label) == 1).alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "t"):
            seen: set[tuple[str, int, bool]] = set()
            for t, y in zip(texts, part.column("y").to_pylist()):
                for clause in CLAUSE.split(t.lower().replace("’", "'")):
                    words = set(WORD.findall(clause))
                    h = hash_clause(clause)
                    seen.update((w, h, y) for w in words)
            if seen:
                w, h, y = zip(*seen)
                yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(h, pa.int64()), pa.array(y)], names=["w", "h", "y"])

    clauses = cut(light.mapInArrow(run, "w string, h long, y boolean").groupBy("w", "h").agg(F.min("y").alias("y0")), "toxicity-clauses")
    of = clauses.groupBy("h").agg(F.min("y0").alias("y0")).agg(F.count_if(F.expr("y0")).alias("p"), F.count_if(F.expr("not y0")).alias("n")).first()
    if not of.p or not of.n:
        return frozenset()
    share = of.p / (of.p + of.n)
    rows = clauses.groupBy("w").agg(F.count_if(F.expr("y0")).alias("p"), F.count_if(F.expr("not y0")).alias("n")).where(F.col("p") >= least)
    own = F.log((F.col("p") + pull * share) / (F.col("n") + pull * (1 - share))) - math.log(share / (1 - share))
    return frozenset(r.w for r in rows.where(own >= odds).select("w").collect() if len(r.w) > 2)


def hash_clause(clause: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(" ".join(clause.split())) - (1 << 63)


def _newton(x: np.ndarray, y: np.ndarray, prior: np.ndarray, pull: float, rounds: int) -> np.ndarray:
    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w)), x.T @ (y - p) - pull * (w - prior))
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit_weights(x: np.ndarray, y: np.ndarray, pull: float = 1.0, rounds: int = 50) -> tuple[tuple[float, ...], float]:
    """Logistic regression with a normal prior around the fixed weights, by Newton steps. Kinds of ORDER are fitted as what
    each weighs above the next; where that came out negative, it is held at nothing and the rest fitted again. A single thing
    is held below LIMIT."""
    names = list(WEIGHTS)
    prior = np.array([*WEIGHTS.values(), BIAS])
    if not len(y):
        return tuple(prior[:-1]), BIAS
    chain = [names.index(k) for k in reversed(ORDER)]
    x, start = np.column_stack([x, np.ones(len(x))]), prior.copy()
    for i, k in enumerate(chain):
        x[:, k] = x[:, chain[i:]].sum(1)
        start[k] = prior[k] - (prior[chain[i - 1]] if i else 0)
    free = np.ones(len(prior), bool)
    while True:
        w = np.zeros(len(prior))
        w[free] = _newton(x[:, free], y, start[free], pull, rounds)
        below = [k for k in chain[1:] if w[k] < 0]
        if not below:
            break
        free[below] = False
    for before, k in zip(chain, chain[1:]):
        w[k] += w[before]
    thing = names.index("thing")
    w[thing] = min(w[thing], (math.log(LIMIT / (1 - LIMIT)) - 0.1 - w[-1]) / math.log(2))
    return tuple(float(v) for v in w[:-1]), float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", modulus: int = 4, held: int = 2, sample: int = SAMPLE) -> Model:
    """Learns from labelled rows that aren't held out, `sample` at most."""
    rows = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~crc_split(key, modulus, held)).groupBy(F.col(key).alias("_key")).agg(F.max(label).alias("_y"))
    rows = rows.orderBy(F.xxhash64("_key"), "_key").limit(sample)
    texts = cut(docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("t")).join(F.broadcast(rows), "_key").groupBy("_key").agg(F.min("t").alias("t"), F.first("_y").alias("y")).select("t", "y"), "toxicity-sample")
    first = Model(learn_words(texts, "t", "y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = matcher(first)
        for part, xs in slices(batches, "t"):
            yield pa.RecordBatch.from_arrays([part.column("y").cast(pa.int32()), pa.array([counts(match(t)) for t in xs], pa.list_(pa.float64()))], names=["y", "x"])

    got = texts.mapInArrow(run, "y int, x array<double>").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).orderBy("x", "y").collect()
    x = np.array([r.x for r in got for _ in range(r.n)]).reshape(-1, len(WEIGHTS))
    weights, bias = fit_weights(x, np.array([r.y for r in got for _ in range(r.n)], float))
    return Model(first.learned, weights, bias)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, matched): matched is an array of (clause, kinds)."""
    light = docs.select(key, F.col(text).cast("string").alias("t"))
    matched = T.ArrayType(T.StructType([T.StructField("clause", T.StringType()), T.StructField("kinds", T.ArrayType(T.StringType()))]))
    out = T.StructType([light.schema.fields[0], T.StructField("score", T.DoubleType()), T.StructField("matched", matched)])
    kind = pa.list_(pa.struct([("clause", pa.string()), ("kinds", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match, w = matcher(model), np.array(model.weights)
        for part, texts in slices(batches, "t"):
            found = [match(t) for t in texts]
            z = np.array([counts(f) for f in found]).reshape(-1, len(w)) @ w + model.bias
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(1 / (1 + np.exp(-z))), pa.array([[{"clause": c, "kinds": k} for c, k in f] for f in found], kind)], names=out.names)

    return light.mapInArrow(run, out)


def keep_below(docs: DataFrame, model: Model, limit: float, text: str = "text") -> DataFrame:
    """Rows of docs, with all their columns, whose text scores below the limit; no row moves."""
    # a plan with Python takes no names with dots
    plain, own = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), f"c{docs.columns.index(text)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match, w = matcher(model), np.array(model.weights)
        for part, texts in slices(batches, own):
            z = np.array([counts(match(t)) for t in texts]).reshape(-1, len(w)) @ w + model.bias
            yield part.filter(pa.array(1 / (1 + np.exp(-z)) < limit))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", crc_split("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"), F.size("matched").alias("n_clauses"))
