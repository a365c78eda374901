"""Class prototypes, distances and nearest neighbours on long tables.

A prototype's table lists the features that its class has; all others of the space have the
prototype's default (1 for gmean, else 0).  Distances of prototypes are given for every pair of class
and test instance: listed cells are joined, all others are closed forms.  Classes are a small closed
space, so (class, instance) grids and (class, cell) rows of the test part are linear in the test part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import value_ranks

#: value of features that a class lacks
DEFAULTS = {"mean": 0.0, "sum": 0.0, "gmean": 1.0, "hmean": 0.0}


def prototypes(train: DataFrame, class_map: DataFrame, how: str = "mean") -> DataFrame:
    """(label, feature, value) from (instance_id, feature, value); how: mean, sum, gmean or hmean.

    An instance with several labels counts in each of their classes.  Means are over all instances
    of the class, absent features being 0 (mean) or left out (gmean, hmean).
    """
    size = class_map.groupBy("label").agg(F.count("*").alias("n_c"))
    x = F.col("value").cast("double")
    sums = train.join(class_map, "instance_id").groupBy("label", "feature").agg(F.sum(x).alias("s"), F.sum(F.ln(x)).alias("ln"), F.sum(1 / x).alias("inverse"))
    value = {"sum": F.col("s"), "mean": F.col("s") / F.col("n_c"), "gmean": F.exp(F.col("ln") / F.col("n_c")), "hmean": F.col("n_c") / F.col("inverse")}[how]
    return sums.join(F.broadcast(size), "label").select("label", "feature", value.alias("value"))  # a row for each class


def space_size(*tables: DataFrame) -> DataFrame:
    """One row v: how many features the tables have together."""
    every = tables[0].select("feature")
    for t in tables[1:]:
        every = every.union(t.select("feature"))
    return every.distinct().agg(F.count("*").alias("v"))


def _as_double(table: DataFrame, key: str) -> DataFrame:
    return table.select(key, "feature", F.col("value").cast("double").alias("value"))


def class_cosine(protos: DataFrame, test: DataFrame, size: DataFrame, default: float = 0.0) -> DataFrame:
    """(label, instance_id, dist): 1 - cosine; 1 where a vector has no length or nothing is shared.  `size`: one row v, the space's features."""
    x, y = _as_double(protos, "label"), _as_double(test, "instance_id").withColumnRenamed("value", "y")
    own = x.groupBy("label").agg(F.sum(F.col("value") * F.col("value")).alias("ss"), F.count("*").alias("n")).crossJoin(F.broadcast(size))
    own = own.select("label", F.sqrt(F.col("ss") + default * default * (F.col("v") - F.col("n"))).alias("na"))
    each = y.groupBy("instance_id").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("nb"), F.sum("y").alias("sy"))
    dots = x.join(y, "feature").groupBy("label", "instance_id").agg(F.sum((F.col("value") - default) * F.col("y")).alias("d"))
    both = each.crossJoin(F.broadcast(own)).join(dots, ["label", "instance_id"], "left")
    dot, length = F.coalesce("d", F.lit(0.0)) + default * F.col("sy"), F.col("na") * F.col("nb")
    return both.select("label", "instance_id", F.when(length > 0, F.greatest(F.lit(0.0), 1 - dot / length)).otherwise(1.0).alias("dist"))


def class_skew(protos: DataFrame, test: DataFrame, size: DataFrame, default: float = 0.0, alpha: float = 0.99) -> DataFrame:
    """(label, instance_id, dist): divergence of the class's distribution p from alpha * q + (1 - alpha) * p, q the test text's.

    Features that only p has cost p * ln(1 / (1 - alpha)) each, so only the text's own are joined.
    """
    x = _as_double(protos, "label")
    totals = x.groupBy("label").agg(F.sum("value").alias("s"), F.count("*").alias("n")).crossJoin(F.broadcast(size))
    totals = totals.select("label", (F.col("s") + default * (F.col("v") - F.col("n"))).alias("t"))
    p = x.join(F.broadcast(totals), "label").select("label", "feature", (F.col("value") / F.col("t")).alias("p"))
    sums = test.groupBy("instance_id").agg(F.sum("value").alias("_t"))
    q = test.join(sums, "instance_id").select("instance_id", "feature", (F.col("value") / F.col("_t")).alias("q"))
    if default:
        rows = q.crossJoin(F.broadcast(totals)).join(p, ["label", "feature"], "left").withColumn("p", F.coalesce("p", F.lit(default) / F.col("t")))
    else:
        rows = q.join(p, "feature")
    part = rows.groupBy("label", "instance_id").agg(F.sum(F.col("p") * F.ln(F.col("p") / (alpha * F.col("q") + (1 - alpha) * F.col("p")))).alias("shared"), F.sum("p").alias("mass"))
    grid = sums.select("instance_id").crossJoin(F.broadcast(totals.select("label"))).join(part, ["label", "instance_id"], "left")
    return grid.select("label", "instance_id", (F.coalesce("shared", F.lit(0.0)) + (1 - F.coalesce("mass", F.lit(0.0))) * F.ln(F.lit(1 / (1 - alpha)))).alias("dist"))


def _ranked(table: DataFrame, key: str, size: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cells (key, feature, r), ranks (key, r, n_equal), and by key the number of cells n, the sum and square sum of their ranks, and the rank zero of all others."""
    table = _as_double(table, key)
    levels = value_ranks(table, key, size)
    own = levels.groupBy(key).agg(F.sum("n_equal").alias("n"), F.sum(F.col("n_equal") * F.col("r")).alias("s"), F.sum(F.col("n_equal") * F.col("r") * F.col("r")).alias("ss"))
    own = own.crossJoin(F.broadcast(size)).select(key, "n", "s", "ss", "v", ((F.col("v") - F.col("n") + 1) / 2).alias("zero"))
    return table.join(levels, [key, "value"]).select(key, "feature", "r"), levels.select(key, "r", "n_equal"), own


def _rank_pairs(protos: DataFrame, test: DataFrame, size: DataFrame, default: float):
    if default:
        # cells that have the default's value are like those that aren't listed: the smallest there are
        protos = protos.where(F.round("value", 12) != default)
    x, levels, a = _ranked(protos, "label", size)
    y, _, b = _ranked(test, "instance_id", size)
    a = a.toDF("label", "n_a", "s_a", "ss_a", "v", "zero_a")
    b = b.drop("v").toDF("instance_id", "n_b", "s_b", "ss_b", "zero_b")
    grid = b.crossJoin(F.broadcast(a))
    both = x.withColumnRenamed("r", "rx").join(y.withColumnRenamed("r", "ry"), "feature").join(F.broadcast(a.select("label", "zero_a")), "label").join(b.select("instance_id", "zero_b"), "instance_id")
    return levels, y, grid, both


def out_of_place(protos: DataFrame, test: DataFrame, size: DataFrame, default: float = 0.0) -> DataFrame:
    """(label, instance_id, dist): sum over the space's features of the difference between their average ranks in class and text, zeros ranked too."""
    levels, y, grid, both = _rank_pairs(protos, test, size, default)
    one, two = F.col("rx"), F.col("ry")
    shared = both.groupBy("label", "instance_id").agg(
        F.sum(F.abs(one - two) - F.abs(one - F.col("zero_b")) - F.abs(two - F.col("zero_a"))).alias("d"), F.count("*").alias("n"),
    )
    # a class's cells against a text's zeros depend on the text by the number of its features only
    zeros = grid.select("label", "zero_b").distinct()
    from_class = levels.join(zeros, "label").groupBy("label", "zero_b").agg(F.sum(F.col("n_equal") * F.abs(F.col("r") - F.col("zero_b"))).alias("da"))
    from_text = y.join(grid.select("label", "instance_id", "zero_a"), "instance_id").groupBy("label", "instance_id").agg(F.sum(F.abs(F.col("r") - F.col("zero_a"))).alias("db"))
    rows = grid.join(from_class, ["label", "zero_b"]).join(from_text, ["label", "instance_id"]).join(shared, ["label", "instance_id"], "left")
    neither = F.col("v") - F.col("n_a") - F.col("n_b") + F.coalesce("n", F.lit(0))
    dist = F.col("da") + F.col("db") + F.coalesce("d", F.lit(0.0)) + neither * F.abs(F.col("zero_a") - F.col("zero_b"))
    return rows.select("label", "instance_id", dist.alias("dist"))


def spearman(protos: DataFrame, test: DataFrame, size: DataFrame, default: float = 0.0) -> DataFrame:
    """(label, instance_id, dist): 1 - rank correlation, tie-corrected, over the space's features; null where one side has no spread."""
    _, _, grid, both = _rank_pairs(protos, test, size, default)
    shared = both.groupBy("label", "instance_id").agg(F.sum((F.col("rx") - F.col("zero_a")) * (F.col("ry") - F.col("zero_b"))).alias("c"))
    rows = grid.join(shared, ["label", "instance_id"], "left")
    v, za, zb = F.col("v"), F.col("zero_a"), F.col("zero_b")
    mean = (v + 1) / 2
    # sums of products over all features: those of cells, and zeros' ranks for all others
    product = F.coalesce("c", F.lit(0.0)) + zb * (F.col("s_a") - F.col("n_a") * za) + za * (F.col("s_b") - F.col("n_b") * zb) + v * za * zb
    square = lambda side, zero: F.col(f"ss_{side}") + (v - F.col(f"n_{side}")) * zero * zero - v * mean * mean
    spread = F.sqrt(square("a", za) * square("b", zb))
    return rows.select("label", "instance_id", F.when(spread > 1e-9, 1 - (product - v * mean * mean) / spread).alias("dist"))


def norms(table: DataFrame, key: str) -> DataFrame:
    return table.groupBy(key).agg(F.sqrt(F.sum(F.col("value").cast("double") * F.col("value"))).alias("norm"))


def cosine(train: DataFrame, queries: DataFrame) -> DataFrame:
    """(train_id, instance_id, dist): 1 - cosine of pairs of different ids with a common feature; all others have distance 1.

    The queries are a stated set, small against the training part: their cells are joined with all of it.
    """
    t = train.select("train_id", "feature", F.col("value").cast("double").alias("x"))
    dots = t.join(queries.select("instance_id", "feature", F.col("value").cast("double").alias("y")), "feature").where("train_id <> instance_id")
    dots = dots.groupBy("train_id", "instance_id").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    a, b = norms(train, "train_id").withColumnRenamed("norm", "na"), norms(queries, "instance_id").withColumnRenamed("norm", "nb")
    return dots.join(a, "train_id").join(b, "instance_id").select("train_id", "instance_id", F.greatest(F.lit(0.0), 1 - F.col("dot") / (F.col("na") * F.col("nb"))).alias("dist"))


def skew(train: DataFrame, queries: DataFrame, alpha: float = 0.99) -> DataFrame:
    """(train_id, instance_id, dist) of pairs of different ids with a common feature; all others have distance ln(1 / (1 - alpha))."""
    p = train.join(train.groupBy("train_id").agg(F.sum("value").alias("_t")), "train_id").select("train_id", "feature", (F.col("value") / F.col("_t")).alias("p"))
    q = queries.join(queries.groupBy("instance_id").agg(F.sum("value").alias("_t")), "instance_id").select("instance_id", "feature", (F.col("value") / F.col("_t")).alias("q"))
    both = p.join(q, "feature").where("train_id <> instance_id").groupBy("train_id", "instance_id").agg(
        F.sum(F.col("p") * F.ln(F.col("p") / (alpha * F.col("q") + (1 - alpha) * F.col("p")))).alias("shared"), F.sum("p").alias("mass")
    )
    return both.select("train_id", "instance_id", (F.col("shared") + (1 - F.col("mass")) * F.ln(F.lit(1 / (1 - alpha)))).alias("dist"))


def with_strangers(best: DataFrame, queries: DataFrame, train_ids: DataFrame, furthest: float) -> DataFrame:
    """`best` (instance_id, train_id, dist) and, for queries that share nothing with any training instance, the smallest other train_id at the furthest distance."""
    ends = train_ids.agg(F.min("train_id").alias("_a"))
    second = train_ids.join(F.broadcast(ends), F.col("train_id") > F.col("_a")).agg(F.min("train_id").alias("_b"))
    left = queries.select("instance_id").distinct().join(best, "instance_id", "left_anti").crossJoin(F.broadcast(ends)).crossJoin(F.broadcast(second))  # one row each
    other = F.when(F.col("_a") != F.col("instance_id"), F.col("_a")).otherwise(F.col("_b"))
    return best.unionByName(left.select("instance_id", other.alias("train_id"), F.lit(float(furthest)).alias("dist")).where("train_id IS NOT NULL"))


def nearest(distances: DataFrame, key: str = "train_id") -> DataFrame:
    """(instance_id, key, dist): the nearest one; ties by key.  A struct minimum, so it combines before the shuffle."""
    best = distances.groupBy("instance_id").agg(F.min(F.struct(F.round("dist", 9).alias("dist"), F.col(key))).alias("b"))
    return best.select("instance_id", F.col(f"b.{key}").alias(key), F.col("b.dist").alias("dist"))


def class_distance(distances: DataFrame, class_map: DataFrame, queries: DataFrame, furthest: float = 1.0) -> DataFrame:
    """(instance_id, label, dist): distance to the nearest training instance of each class; classes of which none shares a feature are furthest."""
    labels = class_map.withColumnRenamed("instance_id", "train_id")
    got = distances.join(labels, "train_id").groupBy("instance_id", "label").agg(F.min("dist").alias("dist"))
    grid = queries.select("instance_id").distinct().crossJoin(F.broadcast(class_map.select("label").distinct()))  # classes: a small closed space
    return grid.join(got, ["instance_id", "label"], "left").select("instance_id", "label", F.coalesce("dist", F.lit(float(furthest))).alias("dist"))
