"""Mixing sources to target weights.

Every row gets a hash key. Within its source, rows are ordered by that key, and the mix takes the source's words from
the front up to its budget, over again (another epoch) if the budget is larger than the source. The order is found by
one range sort of narrow rows (source, key, size), prefix sums over the sorted partitions' totals, and a running sum
inside the one partition of each source where the budget falls. A row's share then depends on its own key and its
source's cut alone, so the documents themselves are never moved.

The targets are worked out over one row for each source, in one task: meant for up to some hundred thousand sources.

Defined cases. Null or empty text: size 0, takes nothing. Very long texts: their words are counted whole. Null source: a
source of its own, last in order. Ties: equal keys (repeated rows, same id and text) at the cut deal what is left equally,
rounded down. Empty table: no rows. Columns of the input are never read but those named and pass through, so others may have
any name; one named like the added column (`into`) is replaced by it."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from opinaria.sources.scratch import cut

from .common import columns, n_words, small, whole

SEED = "mix-1"


def mix_key(key: str, text: str, seed: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("")), whole(text)))


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, source_size) with the target of each source: weights repeat over the sources by code point, the budget is
    `share` of all sizes, and no target exceeds `most` times its source; what would is dealt to the rest by weight.

    With a price L, source i gets the lesser of its cap and weight_i * L. Ordered by cap / weight, the capped sources come
    first, so L is (budget - caps before) / (weights from here) at the first source where that isn't above cap / weight;
    from there on it only falls, so that is the largest of those.
    One row for each source: the only step that is not distributed."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    pick = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.select("*", F.element_at(pick, (F.row_number().over(order) - 1) % len(weights) + 1).alias("weight"))
    rows = rows.select("*", (F.col("source_size") * float(most)).alias("cap"), (F.sum("source_size").over(W.partitionBy()) * float(share)).alias("budget"))
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing)
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    rows = rows.select("*", level.alias("level")).select("*", F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(W.partitionBy()).alias("price"))
    return rows.select("source", "source_size", F.coalesce(F.least("cap", F.col("weight") * F.col("price")), F.col("cap")).alias("target"))


def plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = SEED) -> DataFrame:
    """For each source: source_size, target, epochs, and the cut: rows with a key below cut_key are taken once more, rows
    at cut_key take cut_words."""
    light = docs.select(F.col(source).cast("string").alias("source"), mix_key(key, text, seed).alias("k"), n_words(whole(text)).cast("long").alias("size"))
    light = light.where("size > 0").groupBy("source", "k").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("ties"))
    # the partition that a row is sorted into is written down, so that all later steps agree on it
    light = cut(light.repartitionByRange("source", "k").withColumn("part", F.spark_partition_id()), "mix-sorted")
    parts = light.groupBy("source", "part").agg(F.sum("size").alias("words"))
    sizes = docs.select(F.col(source).cast("string").alias("source")).distinct().join(
        parts.groupBy(F.col("source").alias("s")).agg(F.sum("words").alias("w")), F.col("source").eqNullSafe(F.col("s")), "left"
    ).select("source", F.coalesce("w", F.lit(0)).cast("long").alias("source_size"))
    goal = targets(sizes, weights, share, most).withColumn("goal", F.floor("target").cast("long"))
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("goal div source_size")).otherwise(F.lit(0))).withColumn("rest", F.col("goal") - F.col("epochs") * F.col("source_size"))
    goal = cut(goal, "mix-goals")
    upto = parts.withColumn("upto", F.sum("words").over(W.partitionBy("source").orderBy("part")))
    here = upto.alias("p").join(goal.alias("g"), F.expr("p.source <=> g.source")).where("upto - words < rest and rest <= upto").select("g.source", "p.part", F.expr("rest - (upto - words)").alias("left_here"))
    here = small(cut(here, "mix-here"))
    inside = light.alias("l").join(here.alias("h"), F.expr("l.source <=> h.source and l.part = h.part")).select("l.*", "left_here")
    inside = inside.withColumn("run", F.sum("size").over(W.partitionBy("source").orderBy("k").rowsBetween(W.unboundedPreceding, 0)))
    at = inside.where("run - size < left_here and left_here <= run").select(F.col("source").alias("s"), F.col("k").alias("cut_key"), F.expr("(left_here - (run - size)) div ties").alias("cut_words"))
    return goal.join(at, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "epochs", "cut_key", "cut_words")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", into: str = "_mix", **parameters) -> DataFrame:
    """All rows and columns of `docs` with a struct column named `into`: size, source_size, target, taken (words, repeats
    counted) and copies (how often the row is wanted as a whole document; the one at the cut counts as taken)."""
    seed = parameters.get("seed", SEED)
    cuts = small(cut(plan(docs, key, text, source, **parameters), "mix-cuts")).select(F.struct("*").alias("cut"))
    rows = docs.select(F.struct(*columns(docs)).alias("row"), n_words(whole(text)).cast("long").alias("size"), mix_key(key, text, seed).alias("k"))
    rows = rows.join(cuts, F.col("row").getField(source).cast("string").eqNullSafe(F.col("cut.source")), "left")
    below, at = F.coalesce(F.col("k") < F.col("cut.cut_key"), F.lit(False)), F.coalesce(F.col("k") == F.col("cut.cut_key"), F.lit(False))
    taken = F.col("cut.epochs") * F.col("size") + F.when(below, F.col("size")).when(at, F.col("cut.cut_words")).otherwise(F.lit(0))
    mixed = F.struct(
        F.col("size"), F.col("cut.source_size").alias("source_size"), F.col("cut.target").alias("target"),
        taken.cast("long").alias("taken"), (F.col("cut.epochs") + (below | at).cast("int")).cast("int").alias("copies"),
    )
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c != into], mixed.alias(into))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "_mix.size", "_mix.source_size", "_mix.target", "_mix.taken", "_mix.copies")


SQL = rf"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) size,
         md5(concat('{SEED}', '|', coalesce(cast(doc_id as varchar), ''), '|', coalesce(text, ''))) k
  from documents),
s as (select source, cast(sum(size) as bigint) source_size from d group by source),
w as (
  select *, [3.0::double, 1.0::double, 2.0::double][cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as int)] weight,
         cast(source_size as double) * 2.0::double cap, cast(sum(source_size) over () as double) * 1.5::double budget
  from s),
l as (
  select *, (budget - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
            / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as level
  from w),
g as (
  select source, source_size, coalesce(least(cap, weight * max(case when level <= cap / weight then level end) over ()), cap) target
  from l),
e as (
  select *, cast(floor(target) as bigint) goal,
         case when source_size > 0 then cast(floor(target) as bigint) // source_size else 0 end epochs
  from g),
t as (
  select source, k, cast(sum(size) as bigint) size, count(*) ties,
         cast(sum(sum(size)) over (partition by source order by k rows unbounded preceding) as bigint) run
  from d where size > 0 group by source, k),
c as (
  select e.*, t.k cut_key, (goal - epochs * source_size - (run - size)) // ties cut_words
  from e left join t on t.source is not distinct from e.source and run - size < goal - epochs * source_size and goal - epochs * source_size <= run)
select doc_id, size, source_size, target,
       cast(epochs * size + case when k < cut_key then size when k = cut_key then cut_words else 0 end as bigint) taken,
       cast(epochs + case when k <= cut_key then 1 else 0 end as int) copies
from d join c on d.source is not distinct from c.source
"""
