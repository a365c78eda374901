"""Ranks over whole tables or large groups, without a window that a single task holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stored


def row_numbers(df: DataFrame, order: list[Column], groups: list[str] | None = None, out: str = "rn") -> DataFrame:
    """`df` with each row's number from 1 in the given order, within its group if there are any.

    Rows are sorted into ranges of group and order and stored, numbered within (range, group), and
    offset by the rows of the group in earlier ranges.  A group that holds most rows is thus dealt
    over many tasks; only (range, group) counts meet in one.  The order must be total.
    """
    groups = groups or []
    ranged = df.repartitionByRange(*[F.col(g) for g in groups], *order).withColumn("_part", F.spark_partition_id())
    rows = stored(ranged)
    counts = rows.groupBy("_part", *groups).agg(F.count("*").alias("_n"))
    # no group: a row for each range; else most groups lie in one range
    before = F.sum("_n").over(Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_part", *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.coalesce(before, F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy("_part", *groups).orderBy(*order))
    same = starts["_part"] == F.col("_p")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    numbered = rows.withColumn(out, inner).withColumnRenamed("_part", "_p")
    return numbered.join(starts, same).withColumn(out, F.col("_before") + F.col(out)).drop("_p", "_part", "_before", *[f"_g{i}" for i in range(len(groups))])


def value_ranks(table: DataFrame, key: str, size: DataFrame) -> DataFrame:
    """(key, value, n_equal, r): the average rank, from 1, of each value of a key's vector over a space of `size` (one row v) features.

    Features that the long table lacks are zeros; they come first and share the rank (zeros + 1) / 2.
    Only distinct values are ordered, not the features.
    """
    counts = table.groupBy(key, "value").agg(F.count("*").alias("n_equal"))
    whole = Window.partitionBy(key)
    below = F.coalesce(F.sum("n_equal").over(whole.orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = counts.select(key, "value", "n_equal", below.alias("_b"), F.sum("n_equal").over(whole).alias("_n")).crossJoin(F.broadcast(size))  # one row
    return rows.select(key, "value", "n_equal", (F.col("v") - F.col("_n") + F.col("_b") + (F.col("n_equal") + 1) / 2).alias("r"))


def running_sums(df: DataFrame, order: list[Column], value: str, out: str = "before") -> DataFrame:
    """`df` with the sum of `value` over the rows before each, in the given total order; by stored ranges, as in row_numbers."""
    rows = stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sums = rows.groupBy("_part").agg(F.sum(value).alias("_s"))
    # a row for each range
    starts = sums.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inner = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn(out, inner).join(starts, F.col("_part") == F.col("_p")).withColumn(out, F.col("_before") + F.col(out)).drop("_part", "_p", "_before")


def looked_up(draws: DataFrame, u: Column, items: DataFrame, most_buckets: int = 1 << 20) -> DataFrame:
    """`draws` with the item whose interval [lo, hi) holds u, for intervals that divide [0, 1) (items: lo, hi and others).

    Two levels instead of a range join: as many buckets of equal width as there are items, joined by
    equality; a bucket holds about two intervals.
    """
    buckets = 1
    n = items.count()
    while buckets < min(n, most_buckets):
        buckets *= 2
    last = F.greatest(F.floor(F.col("lo") * buckets), F.ceil(F.col("hi") * buckets) - 1)
    held = items.where("hi > lo").select("*", F.explode(F.sequence(F.floor(F.col("lo") * buckets), F.least(last, F.lit(buckets - 1)))).alias("_bucket"))
    asked = draws.withColumn("_u", u).withColumn("_bucket", F.floor(F.col("_u") * buckets))
    return asked.join(held, "_bucket").where((F.col("_u") >= F.col("lo")) & (F.col("_u") < F.col("hi"))).drop("_u", "_bucket", "lo", "hi")
