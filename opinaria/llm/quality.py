"""Quality rules whose thresholds adapt to each language and source.

1. features: counts of each whole text, one pass, nothing shuffled.
2. sketch: a quantile sketch with logarithmic buckets (DDSketch): a value v falls into bucket ceil(log(v) / log(g)),
   g = (1 + a) / (1 - a), so a quantile read from it is within the share a of a value that was there. Sketches of any
   parts merge by adding counts, in any order, so results don't depend on how rows are dealt, and Spark's partial
   aggregation does it. A group has some hundred buckets however many rows it has.
3. thresholds: for each (lang, source) and feature, the median plus `width` times the distance from it to an outer quantile
   of the group's own sketch (and minus, where low values fail too). A group of n rows counts as n / (n + pull) of its own
   limit, its language's limit as the rest, on the scale of square roots: one formula at every size, without a least number
   of rows.
4. judge: rows joined with their group's thresholds. A limit is a rate, and a text of n words may expect n times as many
   events; counts scatter around that. A text fails if it has more than its limit lets it expect by CHANCE standard deviations
   of a count (the root of what is expected) and CHANCE events. So where a group has none, because nine tenths of its texts
   have no symbol, say, the limit is 0, but no text fails for four symbols, however short it is.

Defined cases. Null or empty text: no words, fails the base rule. Very long texts: counted whole, in one pass. Null language
or source: a group of its own. Ties: a value at its limit is kept. Repeated rows are judged alike, and each counts in the
sketches. An empty table gives no rows. Columns are read by name and kept under k0, k1..., so others may have any name."""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from opinaria.sources.scratch import cut

from .common import slices, small

SYMBOLS, SPACE, UPPER = b"#*$%&|<>", b" \t\n\x0b\x0c\r", bytes(range(65, 91))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines", "n_echo")
#: Feature: (numerator, denominator, the outer quantile, whether low values fail too, what one event adds to the numerator: a
#: word in capitals some letters, a repeated window its two times eight words; 0: no count of events).
FEATURES = {
    "mean_length": ("word_chars", "n_words", 0.9, True, 0),
    "symbols": ("n_symbols", "n_words", 0.9, False, 1),
    "upper": ("n_upper", "word_chars", 0.9, False, 4),
    "repeats": ("n_repeat_words", "n_words", 0.9, False, 16),
    "echo": ("n_echo", "n_words", 0.9, False, 1),
    "dup_lines": ("n_dup_lines", "n_lines", 0.95, False, 1),
}
ALPHA, WIDTH, PULL, CHANCE = 0.01, 5.0, 400.0, 4.0


def repeat_words(ids: np.ndarray, doc: np.ndarray, window: int = 8) -> np.ndarray:
    """Marks the words that are in a window of eight found twice or more in the same document. Windows get exact numbers
    by doubling: equal pairs, then equal pairs of pairs, and so on."""
    assert window == 8
    covered = np.zeros(len(ids), bool)
    if len(ids) < window:
        return covered
    rank, width = ids.astype(np.int64), 1
    while width < window:
        both = rank[:-width] * (int(rank.max()) + 1) + rank[width:]
        rank, width = np.unique(both, return_inverse=True)[1], 2 * width
    first = doc[: len(rank)]
    inside = np.flatnonzero(first == doc[window - 1 :])
    key = first[inside].astype(np.int64) * (int(rank.max()) + 1) + rank[inside]
    _, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
    edge = np.zeros(len(ids) + 1, np.int64)
    again = inside[n[inverse] > 1]
    np.add.at(edge, again, 1)
    np.add.at(edge, again + window, -1)
    return np.cumsum(edge[:-1]) > 0


def count_texts(texts: list[str]) -> np.ndarray:
    """A column of COUNTS for each text."""
    out = np.zeros((len(COUNTS), len(texts)), np.int64)
    vocab: dict[bytes, int] = {}
    ids: list[int] = []
    for i, t in enumerate(texts):
        b = t.encode()
        words = b.split()
        ids.extend([vocab.setdefault(w, len(vocab)) for w in words])
        lines = [x for x in b.split(b"\n") if x.strip(SPACE)]
        out[:, i] = (
            len(words), len(t) - (len(b) - len(b.translate(None, SPACE))), len(b) - len(b.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), 0, len(b) - len(b.translate(None, UPPER)), len(lines), 0,
        )
    doc = np.repeat(np.arange(len(texts)), out[0])
    ids_of = np.array(ids, np.int64)
    out[4] = np.bincount(doc[repeat_words(ids_of, doc)], minlength=len(texts))
    out[7] = np.bincount(doc[1:][(ids_of[1:] == ids_of[:-1]) & (doc[1:] == doc[:-1])], minlength=len(texts))
    return out


def features(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns and COUNTS of each whole text."""
    light = docs.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keep)], F.col(text).cast("string").alias("t"))
    out = T.StructType([*light.schema.fields[:-1], *(T.StructField(n, T.LongType()) for n in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "t"):
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *map(pa.array, count_texts(texts))], names=out.names)

    return light.mapInArrow(run, out)


def ratio(name: str) -> Column:
    top, under, *_ = FEATURES[name]
    return F.col(top) / F.greatest(F.col(under), F.lit(1))


def sketch(rows: DataFrame, by: list[str], values: dict[str, Column], alpha: float = ALPHA) -> DataFrame:
    """(by..., feature, bucket, n); bucket null for zero."""
    g = math.log((1 + alpha) / (1 - alpha))
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), v.cast("double").alias("v")) for k, v in values.items()])).alias("x")
    bucket = F.when(F.col("x.v") > 0, F.ceil(F.log("x.v") / F.lit(g)).cast("int"))
    return rows.select(*by, pairs).groupBy(*by, F.col("x.feature").alias("feature"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of parts, or of finer groups, made one."""
    return sketches.groupBy(*by, "feature", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, by: list[str], at: dict[str, float], alpha: float = ALPHA) -> DataFrame:
    """(by..., feature, rows, a column for each name in `at`)."""
    gamma = (1 + alpha) / (1 - alpha)
    w = W.partitionBy(*by, "feature")
    run = sketches.select("*", F.sum("n").over(w.orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)).alias("run"), F.sum("n").over(w).alias("rows"))
    value = F.when(F.col("bucket").isNull(), F.lit(0.0)).otherwise(2 * F.pow(F.lit(gamma), F.col("bucket")) / (gamma + 1))
    return run.groupBy(*by, "feature").agg(F.max("rows").alias("rows"), *(F.min(F.when(F.col("run") >= F.ceil(F.col("rows") * q), value)).alias(k) for k, q in at.items()))


def thresholds(rows: DataFrame, lang: str, source: str, width: float = WIDTH, pull: float = PULL) -> DataFrame:
    """A row for each (lang, source): a struct lo, hi for each feature."""
    fine = sketch(rows, [lang, source], {k: ratio(k) for k in FEATURES})
    outer = sorted({v[2] for v in FEATURES.values()})
    at = {"mid": 0.5} | {f"{side}{i}": q if side == "up" else 1 - q for i, q in enumerate(outer) for side in ("up", "down")}
    of = lambda table, side: F.coalesce(*[F.when(F.col(f"{table}.feature") == k, F.col(f"{table}.{side}{outer.index(v[2])}")) for k, v in FEATURES.items()])
    limit = lambda table, side: F.greatest(F.lit(0.0), F.col(f"{table}.mid") + width * (of(table, side) - F.col(f"{table}.mid")))
    both = quantiles(fine, [lang, source], at).alias("o").join(quantiles(merge(fine, [lang]), [lang], at).alias("a"), F.expr(f"o.{lang} <=> a.{lang} and o.feature = a.feature"))
    share = F.col("o.rows") / (F.col("o.rows") + pull)
    drawn = lambda side: F.pow(share * F.sqrt(limit("o", side)) + (1 - share) * F.sqrt(limit("a", side)), 2)
    low = F.col("o.feature").isin(*[k for k, v in FEATURES.items() if v[3]])
    both = both.select(
        F.col(f"o.{lang}"), F.col(f"o.{source}"), F.col("o.feature"),
        F.when(low, drawn("down") * (1 - 2 * ALPHA)).otherwise(F.lit(float("-inf"))).alias("lo"), (drawn("up") * (1 + 2 * ALPHA)).alias("hi"))
    return both.groupBy(lang, source).agg(*(F.max(F.when(F.col("feature") == k, F.struct("lo", "hi"))).alias(k) for k in FEATURES))


def _outside(name: str) -> Column:
    """Whether a row, joined with the limits `t`, is outside of a feature's."""
    top, under, _, low, event = FEATURES[name]
    if not event:
        return (ratio(name) < F.col(f"t.{name}.lo")) | (ratio(name) > F.col(f"t.{name}.hi"))
    expected = F.col(f"t.{name}.hi") * F.greatest(F.col(under), F.lit(1))
    return F.col(top) > expected + CHANCE * F.sqrt(expected * event) + CHANCE * event


def judge(docs: DataFrame, keep: list[str], lang: str = "lang", source: str = "source", text: str = "text", **parameters) -> DataFrame:
    """k0, k1... (the kept columns), COUNTS, base_failed, failed (array of the features outside their group's
    thresholds) and kept."""
    n = len(keep)
    rows = cut(features(docs, [*keep, lang, source], text), "quality-features")
    lang, source = f"k{n}", f"k{n + 1}"
    limits = small(cut(thresholds(rows, lang, source, **parameters), "quality-thresholds")).alias("t")
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    failed = F.array_compact(F.array(*[F.when(_outside(k), F.lit(k)) for k in FEATURES]))
    out = rows.alias("r").join(limits, F.expr(f"r.{lang} <=> t.{lang} and r.{source} <=> t.{source}"), "left").select("r.*", base.alias("base_failed"), failed.alias("failed"))
    return out.drop(lang, source).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def query(spark, sf_dir: str) -> DataFrame:
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    return out.select(F.col("k0").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed", ",").alias("failed"))


def _sql() -> str:
    """The query in SQL: counts by lists of words, sketches by grouping, limits by running sums."""
    g, outer = (1 + ALPHA) / (1 - ALPHA), sorted({v[2] for v in FEATURES.values()})
    real = lambda x: f"cast('{x!r}' as double)"  # noqa: E731  a plain number would be a decimal
    long = " union all ".join(f"select uid, lang, source, '{k}' feature, cast({v[0]} as double) top, greatest({v[1]}, 1) under from c" for k, v in FEATURES.items())
    at = {"mid": 0.5} | {f"{side}{i}": q if side == "up" else 1 - q for i, q in enumerate(outer) for side in ("up", "down")}
    read = lambda by: f"select {by}, feature, max(rows) n_rows, " + ", ".join(f"min(case when run >= ceil(rows * {real(q)}) then value end) {k}" for k, q in at.items()) + (
        f" from (select *, sum(n) over (partition by {by}, feature order by bucket nulls first rows unbounded preceding) run, sum(n) over (partition by {by}, feature) rows, case when bucket is null then 0 else 2 * pow({real(g)}, bucket) / ({real(g + 1)}) end as value"
        f" from (select {by}, feature, bucket, count(*) n from v group by all)) group by all")
    pick = lambda t, side: "case " + " ".join(f"when o.feature = '{k}' then {t}.{side}{outer.index(v[2])}" for k, v in FEATURES.items()) + " end"
    limit = lambda t, side: f"greatest(0, {t}.mid + {WIDTH} * ({pick(t, side)} - {t}.mid))"
    share = f"(o.n_rows / (o.n_rows + {real(PULL)}))"
    drawn = lambda side: f"pow({share} * sqrt({limit('o', side)}) + (1 - {share}) * sqrt({limit('a', side)}), 2)"
    low = ", ".join(f"'{k}'" for k, v in FEATURES.items() if v[3])
    event = "case l.feature " + " ".join(f"when '{k}' then {v[4]}" for k, v in FEATURES.items()) + " end"
    place = "case l.feature " + " ".join(f"when '{k}' then {i}" for i, k in enumerate(FEATURES)) + " end"
    e = "(hi * under)"
    return f"""
with d as (select row_number() over () uid, doc_id, lang, source, coalesce(text, '') t from documents),
w as (select uid, unnest(x) word, generate_subscripts(x, 1) i from (select uid, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') x from d)),
win as (select uid, i, string_agg(word, ' ') over (partition by uid order by i rows between current row and 7 following) as gram, count(*) over (partition by uid order by i rows between current row and 7 following) n from w),
again as (select uid, i from (select uid, i, count(*) over (partition by uid, gram) times from win where n = 8) where times > 1),
rep as (select uid, count(distinct i + k) n from again, range(8) r(k) group by uid),
ech as (select uid, count(*) n from (select uid, word, lag(word) over (partition by uid order by i) before from w) where word = before group by uid),
lin as (select uid, count(*) n, count(distinct line) u from (select uid, unnest(string_split(t, chr(10))) line from d) where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by uid),
c as (select uid, doc_id, lang, source, len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) n_symbols, length(regexp_replace(t, '[^A-Z]', '', 'g')) n_upper,
             coalesce(lin.n, 0) n_lines, coalesce(lin.n - lin.u, 0) n_dup_lines, coalesce(rep.n, 0) n_repeat_words, coalesce(ech.n, 0) n_echo
      from d left join rep using (uid) left join ech using (uid) left join lin using (uid)),
l as ({long}),
v as (select lang, source, feature, case when top > 0 then cast(ceil(ln(top / under) / ln({real(g)})) as int) end bucket from l),
o as ({read('lang, source')}),
a as ({read('lang')}),
t as (select o.lang, o.source, o.feature, case when o.feature in ({low}) then {drawn('down')} * {real(1 - 2 * ALPHA)} else -1 end lo, {drawn('up')} * {real(1 + 2 * ALPHA)} hi
      from o join a on o.lang is not distinct from a.lang and o.feature = a.feature),
f as (select uid, string_agg(l.feature, ',' order by {place}) failed
      from l join t on l.lang is not distinct from t.lang and l.source is not distinct from t.source and l.feature = t.feature
      where case when {event} = 0 then top / under < lo or top / under > hi else top > {e} + {CHANCE} * sqrt({e} * {event}) + {CHANCE} * {event} end group by uid)
select doc_id, cast(n_words as bigint) n_words, cast(word_chars as bigint) word_chars, cast(n_symbols as bigint) n_symbols, cast(n_dup_lines as bigint) n_dup_lines, cast(n_repeat_words as bigint) n_repeat_words,
       n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed, not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and failed is null kept, coalesce(failed, '') failed
from c left join f using (uid)
"""


SQL = _sql()
