"""Feature weights, learned on the training part of each fold: tables (fold, feature, weight).

`features`: (instance_id, feature, value).  `class_map`: (instance_id, label).  `split`: (fold,
instance_id, role).  Everything is counts of non-zero cells and arithmetic on them; the zero band
of a feature is what is left of the fold's totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import row_numbers


def of_role(df: DataFrame, split: DataFrame, role: str) -> DataFrame:
    return df.join(split.where(F.col("role") == role).select("fold", "instance_id"), "instance_id")


def term_frequency(features: DataFrame) -> DataFrame:
    return features.groupBy("feature").agg(F.sum("value").cast("double").alias("weight"))


def document_frequency(features: DataFrame, threshold: float = 0) -> DataFrame:
    return features.groupBy("feature").agg(F.sum(F.when(F.col("value") > threshold, 1).otherwise(0)).cast("double").alias("weight"))


def preset(features: DataFrame, given: DataFrame) -> DataFrame:
    """Weights (feature, w) from a table, 0 for features that it lacks."""
    return features.select("feature").distinct().join(given, "feature", "left").select("feature", F.coalesce("w", F.lit(0.0)).alias("weight"))


def cavnar_trenkle(features: DataFrame, class_map: DataFrame, descending: bool = True) -> DataFrame:
    """Smallest rank over the classes, each ranking its features by frequency, the most common first (rank 0)."""
    sums = features.join(class_map, "instance_id").groupBy("label", "feature").agg(F.sum("value").alias("n"))
    order = F.desc("n") if descending else F.asc("n")
    ranked = row_numbers(sums, [order, F.col("feature")], ["label"])
    return ranked.groupBy("feature").agg(F.min(F.col("rn") - 1).cast("double").alias("weight"))


def entropy_term(n: Column, total: Column) -> Column:
    """-p ln p of a class's share; 0 for none."""
    p = n / total
    return F.when((n > 0) & (total > 0), -p * F.ln(p)).otherwise(0.0)


def _banded(features: DataFrame, band: Column, class_map: DataFrame, instances: DataFrame) -> DataFrame:
    """Information gain of (instance_id, feature, band); band 0 also holds all instances without a row."""
    rows = features.select("instance_id", "feature", band.alias("band")).where("band > 0")
    cells = rows.join(class_map, "instance_id").groupBy("feature", "band", "label").agg(F.count("*").alias("n"))
    held = rows.groupBy("feature", "band").agg(F.count("*").alias("n_band"))
    classes = class_map.groupBy("label").agg(F.count("*").alias("n_c"))
    one = instances.agg(F.count("*").alias("n_all")).crossJoin(classes.agg(F.sum("n_c").alias("m_all")))  # one row
    # the zero band of each feature, class by class: what the other bands leave
    taken = cells.groupBy("feature", "label").agg(F.sum("n").alias("n"))
    grid = features.select("feature").distinct().crossJoin(F.broadcast(classes))  # classes: a small closed space
    zero = grid.join(taken, ["feature", "label"], "left").select("feature", F.lit(0).alias("band"), "label", (F.col("n_c") - F.coalesce("n", F.lit(0))).alias("n"))
    zero_held = features.select("feature").distinct().join(held.groupBy("feature").agg(F.sum("n_band").alias("s")), "feature", "left").crossJoin(one)
    zero_held = zero_held.select("feature", F.lit(0).alias("band"), (F.col("n_all") - F.coalesce("s", F.lit(0))).alias("n_band"))
    every = cells.select("feature", F.col("band").cast("int").alias("band"), "label", "n").unionByName(zero)
    members = Window.partitionBy("feature", "band")
    h = every.withColumn("m", F.sum("n").over(members)).groupBy("feature", "band").agg(F.sum(entropy_term(F.col("n"), F.col("m"))).alias("h"))
    bands = held.select("feature", F.col("band").cast("int").alias("band"), "n_band").unionByName(zero_held)
    inside = h.join(bands, ["feature", "band"]).crossJoin(one).groupBy("feature").agg(F.sum(F.col("n_band") / F.col("n_all") * F.col("h")).alias("inside"))
    prior = classes.crossJoin(one.select("m_all")).agg(F.sum(entropy_term(F.col("n_c"), F.col("m_all"))).alias("h0"))
    return inside.crossJoin(prior).select("feature", (F.col("h0") - F.col("inside")).alias("weight"))


def _present(rows: DataFrame, class_map: DataFrame, instances: DataFrame) -> DataFrame:
    """The gain of presence, from one count for each (feature, class): the absent band is what is left of the totals."""
    held = rows.groupBy("feature").agg(F.count("*").alias("n_f"))
    cells = rows.join(class_map, "instance_id").groupBy("feature", "label").agg(F.count("*").alias("n_fc"))
    classes = class_map.groupBy("label").agg(F.count("*").alias("n_c"))
    one = instances.agg(F.count("*").alias("n_all")).crossJoin(classes.agg(F.sum("n_c").alias("m_all"), F.collect_list("n_c").alias("every")))  # one row
    part = cells.join(F.broadcast(classes), "label").groupBy("feature").agg(F.collect_list(F.struct("n_fc", "n_c")).alias("c"), F.sum("n_fc").alias("m_f"))
    rows = held.join(part, "feature", "left").crossJoin(F.broadcast(one))
    some = F.coalesce("c", F.array().cast("array<struct<n_fc:bigint,n_c:bigint>>"))
    m_f = F.coalesce("m_f", F.lit(0))
    m_0 = F.col("m_all") - m_f
    add = lambda values, term: F.aggregate(values, F.lit(0.0), lambda total, x: total + term(x))
    inside = add(some, lambda x: entropy_term(x["n_fc"], m_f))
    # classes without the feature count whole: all of them, less those with it, plus what these leave
    outside = add(F.col("every"), lambda n: entropy_term(n, m_0)) - add(some, lambda x: entropy_term(x["n_c"], m_0)) + add(some, lambda x: entropy_term(x["n_c"] - x["n_fc"], m_0))
    prior = add(F.col("every"), lambda n: entropy_term(n, F.col("m_all")))
    return rows.select("feature", (prior - (F.col("n_f") * inside + (F.col("n_all") - F.col("n_f")) * outside) / F.col("n_all")).alias("weight"))


def info_gain(features: DataFrame, class_map: DataFrame, instances: DataFrame, bands: str = "presence", n: int = 5, base: float | None = None) -> DataFrame:
    """(feature, weight): class entropy less its mean over bands of the feature's value.

    Bands: presence (zero, non-zero), uniform (n of equal width from 0 to the maximum + 1) or
    equisize (n of equal population, the zeros first).  A band's probability counts instances, its
    entropy counts label memberships.  Natural logarithm, or `base`.
    """
    if bands == "presence":
        got = _present(features.where("value <> 0"), class_map, instances)
    elif bands == "uniform":
        top = features.groupBy("feature").agg(F.max("value").alias("top"))
        rows = features.join(top, "feature")
        got = _banded(rows, F.floor(F.col("value") * n / (F.col("top") + 1)).cast("int"), class_map, instances)
    elif bands == "equisize":
        size = instances.agg(F.count("*").alias("n_all"))
        held = features.groupBy("feature").agg(F.count("*").alias("_n"))
        placed = row_numbers(features.select("instance_id", "feature", "value"), [F.col("value"), F.col("instance_id")], ["feature"])
        rows = placed.join(held, "feature").crossJoin(F.broadcast(size))  # one row
        # zeros stand first: rank among all instances, from 0
        rank = F.col("n_all") - F.col("_n") + F.col("rn") - 1
        got = _banded(rows, F.floor(rank * n / F.col("n_all")).cast("int"), class_map, instances)
    else:
        raise ValueError(bands)
    return got if base is None else got.select("feature", (F.col("weight") / F.ln(F.lit(float(base)))).alias("weight"))


def presence_gain(features: DataFrame, class_map: DataFrame, fold_of: DataFrame, one_vs_rest: bool = False) -> DataFrame:
    """Information gain of presence for all folds at once, by subtraction; (fold, feature, weight) or (fold, label, feature, weight).

    `fold_of`: (instance_id, test_fold); training totals of fold k are the sums over all folds less
    fold k's.  Single-label class maps.
    """
    labelled = class_map.join(fold_of, "instance_id")
    by_class = labelled.groupBy("test_fold", "label").agg(F.count("*").alias("n"))
    folds = fold_of.select(F.col("test_fold").alias("fold")).distinct()
    totals = by_class.groupBy("label").agg(F.sum("n").alias("n"))
    classes = folds.crossJoin(totals).join(by_class.select(F.col("test_fold").alias("fold"), "label", F.col("n").alias("minus")), ["fold", "label"], "left")
    classes = classes.select("fold", "label", (F.col("n") - F.coalesce("minus", F.lit(0))).alias("n_c"))
    classes = classes.withColumn("n_all", F.sum("n_c").over(Window.partitionBy("fold")))
    cells = features.where("value <> 0").join(labelled, "instance_id").groupBy("test_fold", "label", "feature").agg(F.count("*").alias("n"))
    every = cells.groupBy("label", "feature").agg(F.sum("n").alias("n"), F.collect_list(F.struct(F.col("test_fold").alias("f"), F.col("n").alias("c"))).alias("own"))
    minus = F.aggregate("own", F.lit(0).cast("long"), lambda acc, x: acc + F.when(x["f"] == F.col("fold"), x["c"]).otherwise(0))
    train = every.crossJoin(F.broadcast(folds)).select("fold", "label", "feature", (F.col("n") - minus).alias("n_fc")).where("n_fc > 0")
    n_f = F.sum("n_fc").over(Window.partitionBy("fold", "feature"))
    rows = train.withColumn("n_f", n_f).join(F.broadcast(classes), ["fold", "label"])  # folds x classes: a small closed space

    def gain(inside, outside, n1, n0, n, h0):
        return h0 - (n1 * inside + n0 * outside) / n

    if one_vs_rest:
        n, n_c, n_f_, n_fc = (F.col(c) for c in ("n_all", "n_c", "n_f", "n_fc"))
        h = lambda a, t: entropy_term(a, t) + entropy_term(t - a, t)
        return rows.select("fold", "label", "feature", gain(h(n_fc, n_f_), h(n_c - n_fc, n - n_f_), n_f_, n - n_f_, n, h(n_c, n)).alias("weight"))
    prior = classes.groupBy("fold").agg(F.sum(entropy_term(F.col("n_c"), F.col("n_all"))).alias("h0"), F.max("n_all").alias("n"))
    absent = entropy_term(F.col("n_c") - F.col("n_fc"), F.col("n_all") - F.col("n_f"))
    part = rows.groupBy("fold", "feature").agg(
        F.max("n_f").alias("n_f"), F.sum(entropy_term(F.col("n_fc"), F.col("n_f"))).alias("h1"), F.sum(absent).alias("h_some"),
        F.collect_set("label").alias("some"),
    )
    # classes without the feature lie wholly in the zero band
    kept = classes.groupBy("fold").agg(F.collect_list(F.struct("label", "n_c")).alias("all_c"))
    rest = part.join(F.broadcast(kept), "fold").join(F.broadcast(prior), "fold")
    zero = F.aggregate("all_c", F.lit(0.0), lambda acc, x: acc + F.when(F.array_contains("some", x["label"]), 0.0).otherwise(entropy_term(x["n_c"].cast("double"), (F.col("n") - F.col("n_f")).cast("double"))))
    return rest.select("fold", "feature", gain(F.col("h1"), F.col("h_some") + zero, F.col("n_f"), F.col("n") - F.col("n_f"), F.col("n"), F.col("h0")).alias("weight"))


def lang_domain(features: DataFrame, class_map: DataFrame, domains: DataFrame, fold_of: DataFrame, with_domain: bool = True) -> DataFrame:
    """(fold, feature, weight): smallest rank over the classes of the class-against-rest gain less the domain gain.

    `domains`: (instance_id, label) with the domain as label.  Without the domain term: local gain.
    """
    own = presence_gain(features, class_map, fold_of, one_vs_rest=True)
    value = F.round(F.col("weight"), 9)
    if with_domain:
        domain = presence_gain(features, domains, fold_of).withColumnRenamed("weight", "d")
        own = own.join(domain, ["fold", "feature"])
        value = F.round(F.col("weight") - F.col("d"), 9)
    ranked = row_numbers(own.select("fold", "label", "feature", value.alias("v")), [F.desc("v"), F.col("feature")], ["fold", "label"])
    return ranked.groupBy("fold", "feature").agg(F.min(F.col("rn") - 1).cast("double").alias("weight"))


def rank(weights: DataFrame, descending: bool = True) -> DataFrame:
    """`weights` (feature, weight) with rank from 0; ties by feature."""
    w = F.round("weight", 9)
    ranked = row_numbers(weights, [w.desc() if descending else w.asc(), F.col("feature")])
    return ranked.withColumn("rank", (F.col("rn") - 1).cast("long")).drop("rn")


# ---- keep rules and transforms


def highest_n(weights: DataFrame, n: int) -> DataFrame:
    """The n features of largest weight in each fold."""
    if "fold" not in weights.columns:
        return weights.orderBy(F.round("weight", 9).desc(), "feature").limit(n).select("feature")
    keys = ["fold"]
    # Spark cuts each task's rows to the n best of a fold before the shuffle
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.round("weight", 9).desc(), "feature"))
    return weights.withColumn("_p", place).where(F.col("_p") <= n).select(*keys, "feature")


def at_least(weights: DataFrame, x: float) -> DataFrame:
    return weights.where(F.col("weight") >= x).drop("weight")


def less_than(weights: DataFrame, x: float) -> DataFrame:
    return weights.where(F.col("weight") < x).drop("weight")


def nonzero(weights: DataFrame) -> DataFrame:
    return weights.where(F.round("weight", 12) != 0).drop("weight")


def select(features: DataFrame, kept: DataFrame) -> DataFrame:
    """Only kept features; kept may have a fold, then so must features."""
    return features.join(kept, kept.columns, "left_semi").select(features.columns)


def feature_increment(weights: DataFrame, sizes: list[int]) -> DataFrame:
    """(fold, feature): fold i holds the sizes[i] best features of one weight vector."""
    return rank(weights).select(F.explode(F.filter(F.array(*[F.when(F.col("rank") < n, F.lit(i)) for i, n in enumerate(sizes)]), lambda x: x.isNotNull())).alias("fold"), "feature")


def tfidf(features: DataFrame) -> DataFrame:
    """value / instance total / document frequency, without a logarithm, on the table that it is given."""
    total = features.groupBy("instance_id").agg(F.sum("value").alias("_t"))
    df = features.where("value > 0").groupBy("feature").agg(F.count("*").alias("_df"))
    return features.join(total, "instance_id").join(df, "feature").select("instance_id", "feature", (F.col("value") / F.col("_t") / F.col("_df")).alias("value"))


def apply_weights(features: DataFrame, weights: DataFrame, binary: bool = False, cutoff: float | None = None) -> DataFrame:
    rows = features.join(weights, "feature")
    if cutoff is not None:
        rows = rows.where(F.col("value") >= cutoff)
    value = F.col("weight") if binary else F.col("value") * F.col("weight")
    return rows.select("instance_id", "feature", value.cast("double").alias("value")).where("value <> 0")


def discretize(features: DataFrame, coefficient: float) -> DataFrame:
    return features.select("instance_id", "feature", (F.col("value") * coefficient).cast("long").alias("value")).where("value <> 0")
