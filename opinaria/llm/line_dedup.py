"""Line dedup by overlapping three-line windows.

Lines with a word are numbered within a document. Every three consecutive ones make a window, hashed (md5); a single line
of `long_line` words or more is a window of its own, since a passage of that length needs no neighbours to tell it from
chance. The first place of each hash, by id and then position, stays; every line covered by a later place goes, where
overlapping windows cover the run of lines once. Lines without a word are no part of windows and stay.

With `sentences`, lines are cut further at the ends of sentences (`.`, `!` or `?` before spaces), so that a window may start
and end inside a line; a passage that repeats inside longer lines is then found, but for the sentences it cuts at its edges.

Only hashes that are found more than once are looked up again. A hash that stands in a third of all documents costs each
task one row in the counts, and its lookup join is one that Spark can split. A document's covered positions are merged, and
its text cut, in one pass over its lines.

Defined cases. Null or empty text: no lines with words, comes back as it is. Very long texts: their windows are rows like
any others; the time grows with the lines. Ties: equal lines in one document are told apart by position. Repeated rows (same
id and text) are one document: what stays in one stays in all. Null ids come after all others. Empty table: no rows. Extra
columns pass through whatever their names; one named like the added column (`into`) is replaced by it."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from opinaria.sources.scratch import cut

from .common import columns, let, n_words, whole

A_WORD = r"[^\x20\x09-\x0D]"
#: What stands between units: a line's end, or the spaces after a sentence's end.
LINES, SENTENCES = r"\n", r"\n|(?<=[.!?])\x20+"


def content(text: Column, between: str = LINES) -> Column:
    """Array of (i, x): the lines with a word and their numbers."""
    numbered = F.transform(F.split(text, between, -1), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    return F.filter(numbered, lambda s: s["x"].rlike(A_WORD))


def windows(lines: Column, size: int, long_line: int) -> Column:
    """Array of (at, hash): the numbers of the lines of each window."""
    hashed = lambda at, tag, text: F.struct(F.array(*at).alias("at"), F.unhex(F.md5(F.concat(F.lit(tag), text))).alias("hash"))
    several = F.transform(
        F.when(F.size(lines) >= size, F.sequence(F.lit(0), F.size(lines) - size)).otherwise(F.array().cast("array<int>")),
        lambda p: hashed([F.get(lines, p + j)["i"] for j in range(size)], "window|", F.concat_ws("\n", *[F.get(lines, p + j)["x"] for j in range(size)])),
    )
    alone = F.transform(lines, lambda s: F.when(n_words(s["x"]) >= long_line, hashed([s["i"]], "line|", s["x"])))
    return F.concat(several, F.array_compact(alone))


def without(text: Column, gone: Column, between: str) -> Column:
    """The text without the lines whose numbers are in `gone`. Where lines go, one of the breaks between their neighbours
    stays, a line's end before spaces. The time grows with the lines."""
    def joined(parts: Column, kept: Column) -> Column:
        lines, gaps = parts["lines"], parts["gaps"]
        gap = lambda i, j: F.when(F.array_contains(F.slice(gaps, i + 1, j - i), "\n"), "\n").otherwise(F.get(gaps, i)) if between != LINES else F.lit("\n")
        pairs = F.zip_with(F.slice(kept, 1, F.size(kept) - 1), F.slice(kept, 2, F.size(kept) - 1), lambda i, j: F.concat(gap(i, j), F.get(lines, j)))
        return F.when(F.size(kept) > 0, F.concat(F.get(lines, F.get(kept, F.lit(0))), F.array_join(pairs, ""))).otherwise("")

    parts = F.struct(F.split(text, between, -1).alias("lines"), F.regexp_extract_all(text, F.lit(f"({between})"), F.lit(1)).alias("gaps"))
    return let(parts, lambda p: let(F.array_except(F.sequence(F.lit(0), F.size(p["lines"]) - 1), gone), lambda kept: joined(p, kept)))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, long_line: int = 50, sentences: bool = False, into: str = "_lines") -> DataFrame:
    """`docs` with the later repeats cut out of `text`, and a struct column named `into`: n_lines, n_removed."""
    between = SENTENCES if sentences else LINES
    uid = F.xxhash64(F.col(key).cast("string"), whole(text)).alias("uid")
    found = docs.select(F.col(key).alias("id"), uid, content(whole(text), between).alias("lines"))
    found = found.select("id", "uid", F.explode(windows(F.col("lines"), size, long_line)).alias("w")).select("id", "uid", "w.*")
    found = cut(found, "line-windows")
    place = F.struct(F.col("id").isNull().alias("last"), "id", "uid", F.get("at", F.lit(0)).alias("p"))
    places = found.select("hash", place.alias("place")).groupBy("hash").agg(F.min("place").alias("first"), F.max("place").alias("final"))
    repeated = cut(places.where("first <> final").select("hash", "first"), "line-repeated")
    later = found.join(repeated, "hash").where(place != F.col("first"))
    gone = later.groupBy("uid").agg(F.array_distinct(F.flatten(F.collect_set("at"))).alias("gone"))
    rows = docs.select(F.struct(*columns(docs)).alias("row"), uid).join(gone, "uid", "left")
    text_of = F.col("row").getField(text)
    left = without(F.coalesce(text_of.cast("string"), F.lit("")), F.col("gone"), between)
    n_lines = F.size(F.split(F.coalesce(text_of.cast("string"), F.lit("")), between, -1))
    return rows.select(
        *[F.when(F.col("gone").isNull(), text_of).otherwise(left).alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns if c != into],
        F.struct(n_lines.alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).alias("n_removed")).alias(into))


def query(spark, sf_dir: str) -> DataFrame:
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "_lines.n_lines", "_lines.n_removed", "text")


SQL = r"""
with d as (select doc_id, text, string_split(coalesce(text, ''), chr(10)) ls from documents),
c as (
  select doc_id, text, ls, list_filter(range(1, len(ls) + 1), lambda i: regexp_matches(ls[i], '[^\x20\x09-\x0D]')) idx from d),
p as (select doc_id, ls, idx, unnest(range(1, len(idx) + 1)) p from c),
w as (
  select doc_id, p, 3 n, md5(concat('window|', concat_ws(chr(10), ls[idx[p]], ls[idx[p + 1]], ls[idx[p + 2]]))) h from p where p <= len(idx) - 2
  union all
  select doc_id, p, 1, md5(concat('line|', ls[idx[p]])) from p where len(regexp_extract_all(ls[idx[p]], '[^\x20\x09-\x0D]+')) >= 50),
o as (select *, row_number() over (partition by h order by doc_id, p) r from w),
g as (select distinct doc_id, unnest(range(p, p + n)) p from o where r > 1),
x as (select doc_id, list(p) gone from g group by doc_id)
select c.doc_id, cast(len(ls) as int) n_lines, cast(coalesce(len(gone), 0) as int) n_removed,
       case when gone is null then text
            else array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: not list_contains(list_transform(gone, lambda q: idx[q]), i)), lambda i: ls[i]), chr(10)) end as text
from c left join x on x.doc_id = c.doc_id
"""
