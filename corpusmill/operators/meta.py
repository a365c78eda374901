"""Meta-classification as rewrites of the training tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .splits import chance, hash_rank


def one_vs_rest_counts(cells: DataFrame) -> DataFrame:
    """(task, feature, positive, negative): counts for one binary task per class, without K copies of the features.

    `cells`: (label, feature, n) of a single-label map; negative = total - positive.
    """
    totals = cells.groupBy("feature").agg(F.sum("n").alias("t"))
    return cells.join(totals, "feature").select(F.col("label").alias("task"), "feature", F.col("n").alias("positive"), (F.col("t") - F.col("n")).alias("negative"))


def repeat_labels(features: DataFrame, class_map: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An instance with n labels becomes n instances `id#label` with one label each."""
    name = F.concat(F.col("instance_id").cast("string"), F.lit("#"), "label")
    rows = features.join(class_map, "instance_id").select(name.alias("instance_id"), "feature", "value")
    return rows, class_map.select(name.alias("instance_id"), "label")


def replicate(features: DataFrame, class_map: DataFrame, iters: int = 2, seed: str = "replicate") -> tuple[DataFrame, DataFrame]:
    """Each instance gets the features and labels of iters - 1 other instances in hash order added."""
    ids = features.select("instance_id").distinct().withColumn("_g", F.lit(1))
    own = hash_rank(ids, ["_g"], chance(seed, "instance_id"), "instance_id").select("instance_id", "rn", "n")
    links = [own.select("instance_id", F.col("instance_id").alias("source"))]
    for k in range(1, iters):
        shifted = own.select(F.col("instance_id").alias("source"), F.col("rn").alias("to"))
        links.append(own.select("instance_id", ((F.col("rn") - 1 + k) % F.col("n") + 1).alias("to")).join(shifted, "to").select("instance_id", "source"))
    every = reduce(DataFrame.unionByName, links)
    rows = every.join(features.withColumnRenamed("instance_id", "source"), "source").groupBy("instance_id", "feature").agg(F.sum("value").alias("value"))
    labels = every.join(class_map.withColumnRenamed("instance_id", "source"), "source").select("instance_id", "label").distinct()
    return rows, labels


def powerset(class_map: DataFrame) -> DataFrame:
    """Label sets as classes: (instance_id, label) with the sorted labels joined by |."""
    return class_map.groupBy("instance_id").agg(F.array_join(F.array_sort(F.collect_set("label")), "|").alias("label"))


def expand_powerset(predicted: DataFrame) -> DataFrame:
    return predicted.select("instance_id", F.explode(F.split("label", r"\|")).alias("label")).where("label <> ''")


def known_vs_unknown(class_map: DataFrame, unknown: str) -> DataFrame:
    """(task, instance_id, positive): for each known class its instances against the unknown class's only."""
    known = class_map.where(F.col("label") != unknown)
    tasks = known.select(F.col("label").alias("task")).distinct()
    negative = class_map.where(F.col("label") == unknown).select("instance_id").crossJoin(F.broadcast(tasks))  # known classes: a closed space
    return known.select(F.col("label").alias("task"), "instance_id", F.lit(True).alias("positive")).unionByName(negative.select("task", "instance_id", F.lit(False).alias("positive")))


def accept_or_unknown(decisions: DataFrame, unknown: str) -> DataFrame:
    """(instance_id, label) from (task, instance_id, accepted); nothing accepted: the unknown class."""
    yes = decisions.where("accepted").select("instance_id", F.col("task").alias("label"))
    none = decisions.select("instance_id").distinct().join(yes, "instance_id", "left_anti")
    return yes.unionByName(none.select("instance_id", F.lit(unknown).alias("label")))


def ordinal_counts(class_counts: DataFrame, order: DataFrame) -> DataFrame:
    """(task, positive, negative): the K - 1 tasks `greater than class i` from (label, n) and (label, ord)."""
    w = Window.orderBy("ord")
    rows = class_counts.join(order, "label")
    upto = F.sum("n").over(w)
    rows = rows.select(F.col("ord").alias("task"), upto.cast("long").alias("negative"), (F.sum("n").over(Window.partitionBy()) - upto).cast("long").alias("positive"))
    return rows.where("positive > 0")


def ordinal_scores(greater: DataFrame, k: int) -> DataFrame:
    """(instance_id, ord, score) from (instance_id, ord, p) with p = P(class > ord), ord 0..k-2: P(i) = P(> i-1) - P(> i)."""
    ps = greater.groupBy("instance_id").agg(F.map_from_entries(F.collect_list(F.struct("ord", "p"))).alias("m"))
    rows = ps.select("instance_id", "m", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("ord"))
    above = F.when(F.col("ord") == 0, 1.0).otherwise(F.try_element_at("m", F.col("ord") - 1))
    here = F.when(F.col("ord") == k - 1, 0.0).otherwise(F.try_element_at("m", F.col("ord")))
    return rows.select("instance_id", "ord", (above - here).alias("score"))


def stacked_features(scores: dict[str, DataFrame]) -> DataFrame:
    """Out-of-fold scores (instance_id, label, score) of several learners or results as features `name:label`."""
    parts = [s.select("instance_id", F.concat(F.lit(f"{name}:"), "label").alias("feature"), F.col("score").alias("value")) for name, s in sorted(scores.items())]
    return reduce(DataFrame.unionByName, parts)


def unknown_branches(labels: list[str], unknown: str) -> list[tuple[str, str, str]]:
    """(node, label, branch) of one task for each known class: it against the unknown class only."""
    return [(k, x, x) for k in labels if k != unknown for x in (k, unknown)]


def ordinal_branches(order: list[str]) -> list[tuple[str, str, str]]:
    """(node, label, branch) of the K - 1 tasks whether a class comes after the i-th."""
    return [(str(i), x, "after" if j > i else "upto") for i in range(len(order) - 1) for j, x in enumerate(order)]
