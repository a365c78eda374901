"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next stage's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import op1_sharding, op3_mixing, op6_simhash, op8_quality, op10_decontaminate
from corpusmill.llm.common import cut, shared_dir, table


def packed(docs: DataFrame, *needed) -> DataFrame:
    """The columns that an operator reads, and whole rows as one struct that no column of an operator can clash with."""
    return docs.select(*needed, F.struct("*").alias("_row"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts go, since they have fewer than 20 words; very long ones are judged whole.
    Rows are judged each for itself, repeated ones and those with nulls elsewhere too.  All columns
    pass through, also those with a measure's name; an empty table stays empty.
    """
    return op8_quality.assess(packed(docs, "text")).where("kept").select("_row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the one with the smallest doc_id, then fingerprint, then text.

    Rows with a null doc_id belong to no group and stay.  Groups are of rows: unlike rows that share
    a doc_id are in different groups, and each group keeps its own row.  Null and empty texts are
    alike and leave one row; very long ones are compared whole.  All columns pass through, of any
    name and kind; of rows that tie in doc_id, fingerprint and text the one whose JSON has the
    smallest hash stays.  An empty table stays empty.
    """
    fps = cut(op6_simhash.fingerprints(docs, "text", "doc_id").where("id IS NOT NULL"))
    first = cut(op6_simhash.firsts(fps))
    # a doc_id of one row names that row; only for the others are fingerprints needed with the rows
    shared = cut(fps.groupBy("id").count().where("count > 1").select(F.col("id").alias("doc_id")))
    gone = fps.join(first, ["id", "fp"], "left_anti").select(F.col("id").alias("doc_id"))
    alone = packed(docs, "doc_id").join(cut(gone.union(shared).distinct()), "doc_id", "left_anti").select("_row")
    marked = op6_simhash.with_fingerprint(packed(docs, "doc_id", "text").join(shared, "doc_id", "left_semi").select("doc_id", "text", "_row"))
    kept = marked.join(first, (marked.doc_id == first.id) & (marked._fp == first.fp), "left_semi")
    rank = F.struct("text", F.sha2(F.to_json("_row", {"ignoreNullFields": "false"}), 256))
    kept = kept.groupBy("doc_id", "_fp").agg(F.min_by("_row", rank).alias("_row")).select("_row")
    return alone.union(kept).select("_row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item.

    Texts are searched and rows dropped by the text's MD5, so rows with a null doc_id are searched
    like any other, and rows that share a doc_id are judged each for itself; equal texts go together.
    Null and empty texts stay; very long ones are searched whole.  All columns pass through; an
    empty table of either kind drops nothing.
    """
    texts = docs.select(F.md5("text").alias("_text_id"), "text")
    leaks = cut(op10_decontaminate.contaminated(texts, table(spark, sf_dir, "benchmark"), key="_text_id").select("_text_id").distinct())
    return docs.join(leaks, F.md5(docs["text"]) == leaks["_text_id"], "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix to target weights: a row for each copy that it takes, in training order.

    Null and empty texts have no words and are never taken; very long ones count whole.  A null
    source is a source of its own; rows with a null doc_id stand where the empty string's hash does.
    Repeated rows are mixed each for itself.  All columns pass through, also those with a result's
    name; an empty table stays empty.
    """
    rows = packed(docs, "doc_id", "source", op3_mixing.n_words(F.col("text")).alias("size"))
    mixed = op3_mixing.mix(rows, op3_mixing.weights(), op3_mixing.slopes(), size=F.col("size"))
    return op3_mixing.in_training_order(mixed, ["doc_id", "_row"]).select("_row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the shard that each belongs to.

    Rows that share a doc_id share a shard, and null ones are a doc_id too; texts aren't read.  All
    columns pass through but for one of the name shard, which is replaced; an empty table stays empty.
    """
    return op1_sharding.assign_shards(docs, op1_sharding.shard_names())


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix_sources),
    ("sharding", shard),
]

#: XXH64 and Golay decoding have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
