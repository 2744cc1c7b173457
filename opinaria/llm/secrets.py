"""Secret scans judged by who owns a value.

1. spans: candidate spans of each whole text, by patterns of several kinds, with code point positions.
2. ownership: each candidate's hash with the number of distinct repositories and owners that have it, over the whole
   corpus. Repeated (hash, owner, repository) are dropped before they are counted, so a value that a third of all rows
   carry costs each task one row.
3. scan: spans joined with their value's ownership. A value that `many` or more owners hold, that stands in `wide` or more
   repositories, or that doesn't look live (few different characters, or a placeholder's word), is an example; one that a
   single owner holds in `few` repositories at most and that looks live is live; others are shared.

Positions come without Python: the pieces between matches and the matches themselves are cut by the same pattern, and
their lengths add up, within blocks of 64 matches and over the blocks, so the time grows with the matches.

Defined cases. Null or empty text: no spans. Very long texts: scanned whole. Null owner or repository: counted as one of its
own. Ties: spans that start at one place stand in the order of their kinds. Repeated rows: each gives its own output row and
counts once in ownership. Empty table: no rows. Columns are read by name, so others may have any name."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from opinaria.sources.scratch import cut

from .common import let, whole

#: Fixed patterns: kind -> (pattern, group with the value, least length of the value). Runs that are too short are dropped
#: after matching where that can change what is matched next, within the pattern where it can't.
KINDS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
    "prefixed": (r"(?:ghp|gho|ghs|ghu|ghr)_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 10),
}
BASE = ("assign", "access", "hex")
#: Fixed words of placeholders, and the least different characters of a value that looks live.
PLACEHOLDER, LEAST_CHARS = r"example|sample|dummy|changeme|placeholder|your|xxxx|1234567|abcdef", 6
_SPAN = "array<struct<start:int,rank:int,end:int,kind:string,hash:string,looks_live:boolean>>"
_BLOCK = 64


def kind_spans(text: Column, kind: str, rank: int) -> Column:
    """Array of (start, rank, end, kind, hash of the value, whether it looks live) of the leftmost non-overlapping matches."""
    pattern, group, least = KINDS[kind]
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    parts = F.filter(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), matches.alias("match"), values.alias("value")), lambda x: x["match"].isNotNull())
    none = F.array().cast(_SPAN)
    width = lambda x: F.length(x["gap"]) + F.length(x["match"])
    live = lambda v: (F.size(F.array_distinct(F.split(v, ""))) >= LEAST_CHARS) & ~F.lower(v).rlike(PLACEHOLDER)

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        span = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), F.sha2(x["value"], 256).alias("hash"), live(x["value"]).alias("looks_live")))
        return F.struct(end.alias("at"), F.when(F.length(x["value"]) >= least, F.concat(state["spans"], span.cast(_SPAN))).otherwise(state["spans"]).alias("spans"))

    def starts(blocks: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        widths = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + width(x)))
        return F.aggregate(widths, first, lambda s, w: F.struct((s["at"] + w).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts")))["starts"]

    # what is appended to is never longer than a block, or than the number of blocks
    in_blocks = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / _BLOCK).cast("int")), lambda b: F.slice(p, b * _BLOCK + 1, F.lit(_BLOCK)))
    of_block = lambda b, at: F.aggregate(b, F.struct(at.alias("at"), none.alias("spans")), step)["spans"]
    found = let(parts, lambda p: F.when(F.size(p) > 0, let(in_blocks(p), lambda blocks: F.flatten(F.zip_with(blocks, starts(blocks), of_block)))).otherwise(none))
    return F.when(text.rlike(pattern), found).otherwise(none)


def spans(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """k0, k1... (the kept columns) and `spans`, ordered by start, then by kind as listed."""
    return docs.select(
        *[F.col(k).alias(f"k{i}") for i, k in enumerate(keep)],
        F.array_sort(F.concat(*[kind_spans(whole(text), kind, i) for i, kind in enumerate(KINDS)])).alias("spans"))


def ownership(found: DataFrame, repo: str, owner: str) -> DataFrame:
    """(hash, repos, owners, rows, looks_live): the distinct repositories and owners of each value."""
    each = found.select(F.explode(F.array_distinct(F.transform("spans", lambda x: F.struct(x["hash"].alias("hash"), x["looks_live"].alias("looks_live"))))).alias("x"), F.col(owner).cast("string").alias("owner"), F.col(repo).cast("string").alias("repo"))
    pairs = each.groupBy("x.hash", "x.looks_live", "owner", "repo").agg(F.count(F.lit(1)).alias("rows"))
    by_owner = pairs.groupBy("hash", "looks_live", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("rows").alias("rows"))
    return by_owner.groupBy("hash", "looks_live").agg(F.sum("repos").alias("repos"), F.count(F.lit(1)).alias("owners"), F.sum("rows").alias("rows"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", repo: str = "doc_id", owner: str = "source", many: int = 3, wide: int = 10, few: int = 3) -> DataFrame:
    """A row for each row of docs: key, spans (start, rank, end, kind, hash), and verdicts: a map from each value's hash to
    live, shared or example. Pass the columns that tell repositories and owners apart."""
    found = cut(spans(docs, [key, repo, owner], text).withColumn("id", F.xxhash64("k0", "k1", "k2", F.to_json("spans"))), "secret-spans")
    held = found.where(F.size("spans") > 0)
    copied, own = (F.col("owners") >= many) | (F.col("repos") >= wide) | ~F.col("looks_live"), (F.col("owners") == 1) & (F.col("repos") <= few)
    verdict = F.when(copied, "example").when(own, "live").otherwise("shared")
    judged = cut(ownership(held, "k1", "k2").select("hash", verdict.alias("verdict")), "secret-verdicts")
    # rows with the same key, repository, owner and spans get the same map, so it is made once for all of them
    each = cut(held.select("id", F.explode(F.array_distinct(F.col("spans.hash"))).alias("hash")).distinct(), "secret-hashes")
    maps = each.join(judged, "hash").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("hash", "verdict"))).alias("verdicts"))
    return found.join(maps, "id", "left").select(F.col("k0").alias(key), "spans", "verdicts")


def query(spark, sf_dir: str) -> DataFrame:
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    count = lambda test: F.size(F.filter("spans", test)).cast("long")
    of_kind = lambda k: count(lambda x: x["kind"] == k)
    joined = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    judged = lambda v: count(lambda x: F.coalesce(F.element_at("verdicts", x["hash"]) == v, F.lit(False)))
    return out.select(
        "doc_id", *(of_kind(k).alias(f"n_{k}") for k in BASE),
        F.sha2(joined(F.filter("spans", lambda x: x["kind"].isin(*BASE))), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        *(judged(v).alias(f"n_{v}") for v in ("live", "shared", "example")))


def _sql_kind(kind: str, rank: int) -> str:
    pattern, group, least = KINDS[kind]
    pattern = pattern.replace("'", "''")
    return f"""select doc_id, source, '{kind}' kind, {rank} rank, {least} least, string_split_regex(t, '{pattern}') gaps, regexp_extract_all(t, '{pattern}', 0) ms,
           regexp_extract_all(t, '{pattern}', {group}) vs from d where regexp_matches(t, '{pattern}')"""


SQL = f"""
with d as (select doc_id, coalesce(source, chr(0)) source, coalesce(text, '') t from documents),
m as ({' union all '.join(_sql_kind(k, i) for i, k in enumerate(KINDS))}),
e as (select doc_id, source, kind, rank, least, gaps, ms, vs, unnest(range(1, len(ms) + 1)) i from m),
p as (
  select doc_id, source, kind, rank, least, vs[i] v, length(ms[i]) size,
         sum(length(gaps[i]) + length(ms[i])) over (partition by doc_id, kind order by i rows unbounded preceding) upto
  from e),
s as (
  select doc_id, source, kind, rank, v, cast(upto - size as bigint) a, cast(upto as bigint) b, concat(kind, ':', cast(upto - size as bigint), ':', cast(upto as bigint)) said
  from p where length(v) >= least),
o as (
  select v, count(distinct source) owners, count(distinct concat(source, chr(0), cast(doc_id as varchar))) repos,
         len(list_distinct(string_split(v, ''))) >= {LEAST_CHARS} and not regexp_matches(lower(v), '{PLACEHOLDER}') looks_live
  from s group by v),
j as (
  select v, case when owners >= 3 or repos >= 10 or not looks_live then 'example' when owners = 1 and repos <= 3 then 'live' else 'shared' end verdict from o),
g as (
  select doc_id, count(*) filter (where kind = 'assign') n_assign, count(*) filter (where kind = 'access') n_access, count(*) filter (where kind = 'hex') n_hex,
         string_agg(said, ',' order by a, rank) filter (where rank < {len(BASE)}) base, string_agg(said, ',' order by a, rank) spans,
         count(*) filter (where verdict = 'live') n_live, count(*) filter (where verdict = 'shared') n_shared, count(*) filter (where verdict = 'example') n_example
  from s join j on s.v = j.v group by doc_id)
select d.doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans,
       coalesce(n_live, 0) n_live, coalesce(n_shared, 0) n_shared, coalesce(n_example, 0) n_example
from d left join g on d.doc_id = g.doc_id
"""
