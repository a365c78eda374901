"""Samples by hash: proportions, halves and bootstraps."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stored
from .ranking import looked_up, row_numbers, running_sums
from .splits import chance, hash_rank


def unit(seed: str, *columns) -> Column:
    """A number in [0, 1) from a hash."""
    return F.conv(F.substring(chance(seed, *columns), 1, 8), 16, 10).cast("double") / 16**8


def _ranked(instances: DataFrame, seed: str) -> DataFrame:
    return hash_rank(instances.select("instance_id", F.lit(1).alias("_g")), ["_g"], chance(seed, "instance_id"), "instance_id")


def proportions(instances: DataFrame, shares: list[float], seed: str) -> DataFrame:
    """(instance_id, chunk): chunks of floor(p * n) instances in hash order; the first takes what rounding leaves."""
    rows = _ranked(instances, seed)
    sizes = [F.floor(F.lit(p) * F.col("n") + 1e-9) for p in shares[1:]]
    chunk, start = F.lit(len(shares) - 1), F.col("n")
    ends = []
    for s in reversed(sizes):
        start = start - s
        ends.append(start)
    for i, end in enumerate(ends):  # from the last chunk's start to the first's end
        chunk = F.when(F.col("rn") <= end, len(shares) - 2 - i).otherwise(chunk)
    return rows.select("instance_id", chunk.cast("int").alias("chunk"))


def ceil_half(instances: DataFrame, seed: str) -> DataFrame:
    return _ranked(instances, seed).where(F.col("rn") <= F.ceil(F.col("n") / 2)).select("instance_id")


def bootstrap_ci(values: DataFrame, column: str, stat: str, alpha: float = 0.05, b: int = 2000, seed: str = "bootstrap") -> DataFrame:
    """One row low, high: percentile interval at significance alpha of a statistic over b resamples, drawn value by value.

    For samples whose b * n draws may each be a row; `bootstrap_histogram` needs a row for each distinct value only.
    """
    indexed = row_numbers(values.select(F.col(column).alias("value"), F.monotonically_increasing_id().alias("_id")), [F.col("value"), F.col("_id")]).select("value", (F.col("rn") - 1).alias("i"))
    indexed = stored(indexed)
    n = indexed.count()
    draws = values.sparkSession.range(b * n).select(F.floor(F.col("id") / max(n, 1)).alias("b"), (F.col("id") % max(n, 1)).alias("k"))
    picked = draws.select("b", F.floor(unit(seed, "b", "k") * n).cast("long").alias("i")).join(indexed, "i")
    return _interval(picked.groupBy("b").agg(getattr(F, stat)("value").alias("s")), alpha, b)


def _interval(stats: DataFrame, alpha: float, b: int) -> DataFrame:
    """Two order statistics of b rows (s)."""
    place = F.row_number().over(Window.orderBy("s"))  # b rows, a parameter
    low, high = max(int(round(alpha * b / 2 + 1e-9)), 0), max(int(round(b * (1 - alpha / 2) - 1e-9)) - 1, 0)
    ranked = stats.select("s", (place - 1).alias("p"))
    return ranked.agg(F.max(F.when(F.col("p") == low, F.col("s"))).alias("low"), F.max(F.when(F.col("p") == high, F.col("s"))).alias("high"))


def resample_pmf(pmf: DataFrame, seed: str, draws: int | None = None) -> DataFrame:
    """(label, n): as many draws as the counts (label, n) hold, or `draws`, by their shares; each draw a row, looked up by buckets."""
    total = pmf.agg(F.sum("n")).first()[0] or 0
    bounds = running_sums(pmf, [F.col("label")], "n", "lo").select("label", (F.col("lo") / total).alias("lo"), ((F.col("lo") + F.col("n")) / total).alias("hi"))
    rows = pmf.sparkSession.range(total if draws is None else draws).withColumnRenamed("id", "draw")
    # whole numbers over the total, like the bounds, so that a draw at a bound is in the upper interval
    return looked_up(rows, F.floor(unit(seed, "draw") * total) / total, bounds).groupBy("label").agg(F.count("*").alias("n"))


def _binomials(rows: DataFrame, seed: str) -> DataFrame:
    """(b, node, n, left, right) -> (b, node, k): how many of n draws go left; by the hash of seed, b and node."""

    def run(batches):
        for batch in batches:
            out = []
            for b, node, n, left, right in zip(*(c.to_pylist() for c in batch.columns)):
                rng = np.random.default_rng(int.from_bytes(hashlib.md5(f"{seed}|{b}|{node}".encode()).digest(), "little"))
                out.append(int(rng.binomial(n, left / (left + right))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64())], ["b", "node", "k"])

    return rows.select("b", "node", "n", "left", "right").mapInArrow(run, "b long, node long, k long")


def resample_histogram(pmf: DataFrame, seed: str, b: int = 1, draws: int | None = None) -> DataFrame:
    """(b, label, n): b resamples of the counts (label, n), each of `draws` draws (as many as the counts hold unless given).

    The draws are divided down a binary tree over the labels: at each node a binomial number of them
    goes left.  So there is no row for a draw, only for a label that gets some; nothing is broadcast.
    """
    spark = pmf.sparkSession
    leaves = stored(row_numbers(pmf.where("n > 0"), [F.col("label")]).select("label", "n", (F.col("rn") - 1).alias("leaf")))
    total, size = leaves.agg(F.sum("n"), F.count("*")).first()
    if not size:
        return spark.range(0).select(F.col("id").alias("b"), F.lit(None).cast(pmf.schema["label"].dataType).alias("label"), F.col("id").alias("n"))
    height = max(0, (size - 1).bit_length())
    state = spark.range(b).select(F.col("id").alias("b"), F.lit(0).cast("long").alias("node"), F.lit(total if draws is None else draws).cast("long").alias("n"))
    for level in range(height):
        # weights of the halves of each node: its leaves share all but the last bits
        bit = height - level - 1
        half = F.shiftright("leaf", bit)
        halves = leaves.groupBy(F.shiftright("leaf", bit + 1).alias("node")).agg(
            F.sum(F.when(half % 2 == 0, F.col("n")).otherwise(0)).alias("left"), F.sum(F.when(half % 2 == 1, F.col("n")).otherwise(0)).alias("right")
        )
        rows = state.join(halves, "node").withColumn("node", F.col("node") + (F.lit(1).cast("long") * 2**level))  # a name for each node of the tree
        split = rows.join(_binomials(rows, seed).withColumnRenamed("k", "left_n"), ["b", "node"]).withColumn("node", F.col("node") - 2**level)
        both = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left_n").alias("n")), F.struct((F.col("node") * 2 + 1).alias("node"), (F.col("n") - F.col("left_n")).alias("n")))
        state = stored(split.select("b", F.inline(both)).where("n > 0"))
    return state.join(leaves.select("label", F.col("leaf").alias("node")), "node").select("b", "label", "n")


def bootstrap_histogram(pmf: DataFrame, alpha: float = 0.05, b: int = 2000, seed: str = "bootstrap") -> DataFrame:
    """One row low, high: percentile interval of the mean of a numeric label over b resamples of its counts (label, n)."""
    drawn = resample_histogram(pmf, seed, b)
    return _interval(drawn.groupBy("b").agg((F.sum(F.col("label") * F.col("n")) / F.sum("n")).alias("s")), alpha, b)
