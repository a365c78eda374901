"""Results: predicted labels, confusion counts and metrics.

gold and predicted are (fold, instance_id, label) with any number of labels; undefined metrics are
null, so that averages skip them.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import special as sp
from . import metadata as md
from .ranking import row_numbers


def highest(scores: DataFrame, keys: list[str], descending: bool = True) -> DataFrame:
    """The best label of each instance; ties go to the first label.  A struct minimum: it combines before the shuffle."""
    s = F.round("score", 9)
    best = scores.groupBy(*keys).agg(F.min(F.struct((-s if descending else s).alias("s"), "label")).alias("b"))
    return best.select(*keys, F.col("b.label").alias("label"))


def nonzero(scores: DataFrame, keys: list[str]) -> DataFrame:
    return scores.where("score > 0").select(*keys, "label")


def confusion(gold: DataFrame, predicted: DataFrame, instances: DataFrame, class_space: DataFrame) -> DataFrame:
    """(fold, label, tp, fp, fn, tn) for every class of the space and every fold of `instances` (fold, instance_id)."""
    g, p = gold.select("fold", "instance_id", "label", F.lit(1).alias("g")), predicted.select("fold", "instance_id", "label", F.lit(1).alias("p"))
    cells = g.join(p, ["fold", "instance_id", "label"], "full").groupBy("fold", "label").agg(
        F.count(F.when(F.col("g").isNotNull() & F.col("p").isNotNull(), 1)).alias("tp"), F.count(F.when(F.col("g").isNull(), 1)).alias("fp"), F.count(F.when(F.col("p").isNull(), 1)).alias("fn")
    )
    grid = instances.groupBy("fold").agg(F.count("*").alias("n")).crossJoin(F.broadcast(class_space.select("label")))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "fp", "fn")]
    rows = grid.join(cells, ["fold", "label"], "left").select("fold", "label", *zero, "n")
    return rows.select("fold", "label", "tp", "fp", "fn", (F.col("n") - F.col("tp") - F.col("fp") - F.col("fn")).alias("tn"))


def class_pairs(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(fold, instance_id, gold, pred): every combination of an instance's labels."""
    return gold.withColumnRenamed("label", "gold").join(predicted.withColumnRenamed("label", "pred"), ["fold", "instance_id"])


def pair_lists(gold: DataFrame, predicted: DataFrame, chunk: int = 100_000) -> DataFrame:
    """(gold, pred, part, ids): the instances of each pair of classes, sorted, at most `chunk` in a row; part counts a pair's rows from 0."""
    rows = class_pairs(gold, predicted).select("instance_id", "gold", "pred").distinct()
    placed = row_numbers(rows, [F.col("instance_id")], ["gold", "pred"]).withColumn("part", F.floor((F.col("rn") - 1) / chunk).cast("int"))
    return placed.groupBy("gold", "pred", "part").agg(F.array_sort(F.collect_list("instance_id")).alias("ids"))


def stacked(results: dict[str, DataFrame], meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results (fold, instance_id, label) one below the other, with their result_id, and the metadata (key, value) that all of them share."""
    ids = sorted(results)
    rows = reduce(DataFrame.unionByName, [results[k].withColumn("result_id", F.lit(k)) for k in ids])
    return rows, md.shared(meta.where(F.col("result_id").isin(ids)))


def mean_times(folds: DataFrame) -> DataFrame:
    """(result_id, avg_learn, avg_classify) from (result_id, fold, learn_time, classify_time); a fold without a time counts in neither mean."""
    return folds.groupBy("result_id").agg(F.avg("learn_time").alias("avg_learn"), F.avg("classify_time").alias("avg_classify"))


def class_matrix(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(gold, pred, n) over all folds; in each fold only classes with both gold and predicted instances count."""
    both = gold.select("fold", "label").distinct().join(predicted.select("fold", "label").distinct(), ["fold", "label"])
    rows = class_pairs(gold, predicted)
    rows = rows.join(both.withColumnRenamed("label", "gold"), ["fold", "gold"], "left_semi").join(both.withColumnRenamed("label", "pred"), ["fold", "pred"], "left_semi")
    return rows.groupBy("gold", "pred").agg(F.count("*").alias("n"))


def precision(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(tp + fn == 0, None).when(tp + fp == 0, 0.0).otherwise(tp / (tp + fp))


def recall(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(tp + fn == 0, None).otherwise(tp / (tp + fn))


def fscore(tp: Column, fp: Column, fn: Column, beta: float = 1.0) -> Column:
    b = beta * beta
    return F.when(tp + fn == 0, None).when(tp == 0, 0.0).otherwise((1 + b) * tp / ((1 + b) * tp + b * fn + fp))


def mcc(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    a, b, c, d = (x.cast("double") for x in (tp, fp, fn, tn))
    y = (a + b) * (a + c) * (d + b) * (d + c)
    return F.when(y == 0, None).otherwise((a * d - b * c) / F.sqrt(y))


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall and F; zeros, not null, where tp is 0."""
    zero = tp == 0
    return [F.when(zero, 0.0).otherwise(f(tp, fp, fn)) for f in (precision, recall, fscore)]


CELLS = ("tp", "fp", "fn")


def summed(confusion_: DataFrame, keys: list[str]) -> DataFrame:
    return confusion_.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in (*CELLS, "tn")])


def micro(confusion_: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Metrics of the sums over all classes (and folds, unless fold is a key)."""
    c = [F.col(x) for x in CELLS]
    return summed(confusion_, list(keys)).select(*keys, precision(*c).alias("precision"), recall(*c).alias("recall"), fscore(*c).alias("fscore"))


def macro(confusion_: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Means over the classes for which a metric is defined; n_ignored classes have no gold instance."""
    c = [F.col(x) for x in CELLS]
    rows = summed(confusion_, [*keys, "label"])
    means = [F.avg(f(*c)).alias(n) for f, n in ((precision, "precision"), (recall, "recall"), (fscore, "fscore"))]
    return rows.groupBy(*keys).agg(*means, F.count(F.when(F.col("tp") + F.col("fn") == 0, 1)).alias("n_ignored"))


def correct(gold: DataFrame, predicted: DataFrame, instances: DataFrame) -> DataFrame:
    """(fold, instance_id, correct): is an instance right in all classes?  Mismatches come from one full join."""
    wrong = gold.withColumn("g", F.lit(1)).join(predicted.withColumn("p", F.lit(1)), ["fold", "instance_id", "label"], "full").where("g IS NULL OR p IS NULL").select("fold", "instance_id").distinct()
    return instances.select("fold", "instance_id").join(wrong.withColumn("w", F.lit(1)), ["fold", "instance_id"], "left").select("fold", "instance_id", F.col("w").isNull().alias("correct"))


def overall(scores: DataFrame) -> DataFrame:
    return scores.groupBy("instance_id", "label").agg(F.sum("score").alias("score"))


def is_probability(scores: DataFrame) -> DataFrame:
    """One row: all scores in [0, 1], one strictly inside at least?"""
    s = F.col("score")
    return scores.agg(((F.min(s) >= 0) & (F.max(s) <= 1) & F.bool_or((s > 0) & (s < 1))).alias("is_probability"))


def ordinal_errors(matrix: DataFrame, order: DataFrame) -> DataFrame:
    """One row rms, mae from (gold, pred, n) and (label, ord)."""
    rows = matrix.join(F.broadcast(order.toDF("gold", "go")), "gold").join(F.broadcast(order.toDF("pred", "po")), "pred")
    d = F.col("go") - F.col("po")
    return rows.agg(F.sqrt(F.sum(F.col("n") * d * d) / F.sum("n")).alias("rms"), (F.sum(F.col("n") * F.abs(d)) / F.sum("n")).alias("mae"))


def discordant(correct_a: DataFrame, correct_b: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """n01 (only b right) and n10 (only a right) of two results over the same instances."""
    a, b = correct_a.withColumnRenamed("correct", "a"), correct_b.withColumnRenamed("correct", "b")
    return a.join(b, ["fold", "instance_id", *keys]).groupBy(*keys).agg(F.count(F.when(~F.col("a") & F.col("b"), 1)).alias("n01"), F.count(F.when(F.col("a") & ~F.col("b"), 1)).alias("n10"))


def class_discordant(gold: DataFrame, a: DataFrame, b: DataFrame, classes: DataFrame) -> DataFrame:
    """(label, n01, n10): as `discordant`, an instance being right in a class if the prediction has it as the gold standard does.

    An instance counts where one of the results is wrong, so only the classes that it has anywhere are joined.
    """
    marked = [x.select("fold", "instance_id", "label", F.lit(1).alias(n)) for x, n in ((gold, "g"), (a, "a"), (b, "b"))]
    cells = marked[0].join(marked[1], ["fold", "instance_id", "label"], "full").join(marked[2], ["fold", "instance_id", "label"], "full")
    right = [F.col("g").isNotNull() == F.col(n).isNotNull() for n in "ab"]
    counts = cells.groupBy("label").agg(F.count(F.when(~right[0] & right[1], 1)).alias("n01"), F.count(F.when(right[0] & ~right[1], 1)).alias("n10"))
    return classes.select("label").join(counts, "label", "left").select("label", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n01", "n10")])


def mcnemar(counts: DataFrame) -> DataFrame:
    """counts with the continuity-corrected statistic and its p (one degree of freedom); no discordant instance: no statistic, and p is 0."""
    d = F.abs(F.col("n01") - F.col("n10")) - 1
    rows = counts.withColumn("statistic", F.when(F.col("n01") + F.col("n10") > 0, (d * d / (F.col("n01") + F.col("n10"))).cast("double")))
    return rows.withColumn("p", F.coalesce(sp.chi2_tail(F.col("statistic")), F.lit(0.0)))


def randomisation(counts: DataFrame, n: int = 10_000, seed: int = 1) -> DataFrame:
    """counts with p: how often swapping instances at random leaves the better result as good as it is, or better.  Equal results are an error.

    Only the number of discordant instances matters, so a trial is one binomial draw.
    """
    @F.pandas_udf("double")
    def p_value(n01: pd.Series, n10: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(n01, n10):
            draws = np.random.default_rng(seed).binomial(a + b, 0.5, n)
            out.append(float((draws >= max(a, b)).sum() + 1) / (n + 1))
        return pd.Series(out, dtype="float64")

    unequal = F.when(F.col("n01") != F.col("n10"), F.col("n01")).otherwise(F.raise_error(F.lit("both results are equally good")).cast("long"))
    return counts.withColumn("n01", unequal).withColumn("p", p_value("n01", "n10"))


def exact_randomisation(counts: DataFrame) -> DataFrame:
    """What `randomisation` comes to with ever more trials: a binomial tail."""
    a, b = F.col("n01"), F.col("n10")
    p = F.when(a != b, sp.fair_coin_tail(a + b, F.greatest(a, b))).otherwise(F.raise_error(F.lit("both results are equally good")).cast("double"))
    return counts.withColumn("p", p)


def fleiss(ratings: DataFrame) -> DataFrame:
    """One row kappa, simple, z, p from (subject, category, n), zero cells included or not; raters a subject must be equal.

    kappa is the mean of the categories' own kappas, weighted by p (1 - p) of each; `simple` compares
    observed with chance agreement (the two are equal but for rounding).  z is kappa over its standard error.
    """
    subjects = ratings.groupBy("subject").agg(F.sum("n").alias("m"))
    one = subjects.agg(F.count("*").alias("s"), F.max("m").alias("m"), F.min("m").alias("m0"))
    n = F.col("n")
    # subjects without a rating in a category add nothing to any sum
    own = ratings.join(F.broadcast(one), F.lit(True)).groupBy("category", "s", "m", "m0").agg(F.sum("n").alias("c"), F.sum(n * (F.col("m") - n)).alias("apart"), F.sum(n * (n - 1)).alias("agree")).where("c > 0")  # one row is broadcast
    pairs = F.col("s") * F.col("m") * (F.col("m") - 1)
    share = F.col("c") / (F.col("s") * F.col("m"))
    rows = own.select("s", "m", "m0", "agree", share.alias("p"), (share * (1 - share)).alias("b"), F.col("apart"), pairs.alias("pairs"))
    each = 1 - F.col("apart") / (F.col("pairs") * F.col("b"))
    sums = rows.agg(
        F.max("m").alias("m"), F.max("m0").alias("m0"), F.max("pairs").alias("pairs"), F.sum("b").alias("d"), F.sum(F.when(F.col("b") > 0, F.col("b") * each)).alias("k"),
        F.sum(F.col("b") * (1 - 2 * F.col("p"))).alias("skewed"), F.sum("agree").alias("agree"), F.sum(F.col("p") * F.col("p")).alias("p2"),
    )
    d, kappa = F.col("d"), F.col("k") / F.col("d")
    error = F.sqrt(2 * (d * d - F.col("skewed"))) / (d * F.sqrt("pairs"))
    equal = F.when(F.col("m") == F.col("m0"), kappa).otherwise(F.raise_error(F.lit("subjects have different numbers of raters")).cast("double"))
    simple = (F.col("agree") / F.col("pairs") - F.col("p2")) / (1 - F.col("p2"))
    return sums.select(equal.alias("kappa"), simple.alias("simple"), (kappa / error).alias("z")).withColumn("p", sp.normal_two_sided(F.col("z")))
