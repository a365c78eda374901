"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir
from ..shared import stored as cut  # noqa: F401

#: Separators of words: space and \t \n \x0B \f \r.  A word is a maximal run of anything else.
SEPARATORS = r"[\x20\x09-\x0D]+"
ASCII_SEPARATORS = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text):
    """Array of the words of a text column; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: w != "")


def let(value, body):
    """Evaluate `value` once per row and use it many times inside `body`."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph by alternating large-star and small-star.

    `edges` has columns a and b of one orderable type.  Returns (node, component): every node
    that has a link to another one, and the smallest node it can reach, itself included.  Self
    links, nulls and repeated edges are ignored.  Each round is two aggregations and two
    equi-joins, whose skewed keys adaptive execution can split; the edge list is cut after each
    round, and rounds grow with the logarithm of the longest chain.
    """
    spark = edges.sparkSession
    shared_dir(spark)
    e = (
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct().checkpoint()
    )
    before = None
    for _ in range(max_rounds):
        seen = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()
        if seen == before or seen[0] == 0:
            return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = seen
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where("v > u").join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = small.union(least.select("u", F.col("m").alias("v"))).distinct().checkpoint()
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
