"""The corpus pipeline: toxicity, line dedup, near-duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents, in their order; further columns of docs, whatever their names,
pass through. What a stage does with nulls, empty and very long texts, ties, repeated rows and empty tables stands in its
docstring."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from opinaria.llm import bpe, line_dedup, minhash, mixing, toxicity
from opinaria.llm.common import columns, fresh, whole
from opinaria.sources.scratch import cut, scoped, scratch_dir

THRESHOLD = 0.3


def keep_not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the grammar scores as toxic. Null and empty texts have no clauses and stay; very long texts are
    read whole; repeated rows go or stay together; rows with a null id are scored, never learned from. An empty table gives
    an empty table."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_below(docs, model, THRESHOLD)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts later repeats of windows of three sentences or lines out of the texts, so that passages that repeat inside lines
    go too. A document of which nothing is left goes; one that had no words before (null, empty) stays as it is. Of equal
    windows the first by id and place stays, null ids last; repeated rows (same id and text) count as one document. Very long
    texts are cut whole. An empty table gives an empty table."""
    found = fresh(docs, "_lines")
    out = line_dedup.dedup(docs, sentences=True, into=found)
    left = (F.col(f"{found}.n_removed") == 0) | F.col("text").rlike(line_dedup.A_WORD)
    return out.where(left).select(*columns(docs))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: that with the smallest id, null ids last, then the smallest hash of id and text. Of rows
    that repeat id and text, that with the smallest hash of all columns stays, of any types. Documents without shingles (null,
    empty, no words) are in no group and stay, all of them. Very long texts are compared whole. An empty table gives an empty
    table."""
    found = cut(minhash.near_duplicates(docs, shingle=5).where("component is not null").groupBy("uid").agg(F.first("id").alias("id"), F.first("component").alias("component"), F.count(F.lit(1)).alias("rows")), "near-uids")
    kept = found.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "uid")).alias("kept")).select(F.col("kept.uid").alias("uid"))
    gone = found.join(kept, "uid", "left_anti").select("uid")
    again = cut(found.where("rows > 1").join(kept, "uid", "left_semi").select("uid"), "near-again")
    rows = docs.select(F.struct(*columns(docs)).alias("row"), F.xxhash64(F.col("doc_id").cast("string"), whole()).alias("uid"))
    # maps have no order, so rows that share id and text are ordered by what they are as JSON
    told = F.xxhash64(F.to_json("row"))
    one = rows.join(again, "uid").groupBy("uid").agg(F.min_by("row", F.struct(told, F.to_json("row"))).alias("row"))
    out = rows.join(gone.unionByName(again), "uid", "left_anti").select("row").unionByName(one.select("row"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document whole; the one at a source's cut is taken whole once more. Documents
    without words (null, empty) have nothing to take and go; very long ones are counted and taken whole. A null source is a
    source of its own; repeated rows have equal keys and are taken alike. An empty table gives an empty table."""
    found = fresh(docs, "_mix")
    out = mixing.mix(docs, into=found).where(F.col(f"{found}.copies") > 0)
    return out.withColumn(fresh(docs, "_copy"), F.explode(F.sequence(F.lit(1), F.col(f"{found}.copies")))).select(*columns(docs))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the token ids of the whole text, and the digest of what they decode to, a row for each row of docs. Null and
    empty texts have no ids; very long ones are encoded whole; repeated rows are encoded alike. An empty table gives an empty
    table."""
    import public_tokenizers as P

    out = bpe.encode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    return out.select("doc_id", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", keep_not_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("mixing", mix_sources),
    ("tokens", encode_tokens),
]

#: The toxicity, near-duplicate and token stages can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex[:12]}"
    for name, stage in STAGES:
        with scoped(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(f"{root}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{root}/{name}")
    return docs
