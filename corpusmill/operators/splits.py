"""Splits and samples.  Chance is a hash of the seed and the id, so results don't depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import looked_up, running_sums


def chance(seed: str, *columns) -> Column:
    """Hex digits in place of a random number."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") if isinstance(c, str) else c for c in columns]))


def hash_rank(df: DataFrame, groups: list[str], order: Column, ties: str, out: str = "rn") -> DataFrame:
    """`df` with each row's rank (from 1) in its group by a hash, and the group's size n.

    Two-level: counts by (group, first three hex digits), running sums over these, and a window
    inside (group, digits) only.  A group with most of all rows is dealt over 4096 windows.
    """
    rows = df.withColumn("_o", order).withColumn("_b", F.substring("_o", 1, 3))
    counts = rows.groupBy(*groups, "_b").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    size = F.sum("_c").over(Window.partitionBy(*groups))
    counts = counts.select(*groups, "_b", F.coalesce(before, F.lit(0)).alias("_before"), size.alias("n"))
    inner = F.row_number().over(Window.partitionBy(*groups, "_b").orderBy("_o", ties))
    return rows.withColumn("_in", inner).join(counts, [*groups, "_b"]).withColumn(out, F.col("_before") + F.col("_in")).drop("_o", "_b", "_in", "_before", "_c")


def allocate(strata: DataFrame, weights: list[float], seed: str) -> DataFrame:
    """(instance_id, stratum, part): an exact partition of each stratum.

    Part i gets floor(p_i * n) instances; what is left over goes one each to parts in hash order.
    """
    total = float(sum(weights))
    ranked = hash_rank(strata, ["stratum"], chance(seed, "instance_id"), "instance_id")
    sizes = ranked.groupBy("stratum").agg(F.max("n").alias("n"))
    floors = [F.floor(F.lit(w / total) * F.col("n") + 1e-9) for w in weights]
    parts = sizes.select("stratum", "n", F.posexplode(F.array(*floors)).alias("part", "base"))
    turn = F.row_number().over(Window.partitionBy("stratum").orderBy(chance(seed, "stratum", "part"), "part"))
    left = F.col("n") - F.sum("base").over(Window.partitionBy("stratum"))
    parts = parts.withColumn("size", F.col("base") + F.when(turn <= left, 1).otherwise(0))
    upto = F.sum("size").over(Window.partitionBy("stratum").orderBy("part"))
    ends = parts.withColumn("hi", upto).groupBy("stratum").agg(F.array_sort(F.collect_list("hi")).alias("ends"))
    return ranked.join(ends, "stratum").select("instance_id", "stratum", F.size(F.filter("ends", lambda e: e < F.col("rn"))).alias("part"))


def allocate_probably(instances: DataFrame, weights: list[float], seed: str) -> DataFrame:
    """(instance_id, part) by comparing a hash with cumulative shares: no shuffle, sizes only near the shares."""
    total, upto, part = float(sum(weights)), 0.0, F.lit(len(weights) - 1)
    limits = []
    for w in weights[:-1]:
        upto += w / total
        limits.append(f"{int(upto * 16**8):08x}")
    for i, limit in reversed(list(enumerate(limits))):
        part = F.when(F.substring(chance(seed, "instance_id"), 1, 8) < limit, i).otherwise(part)
    return instances.select("instance_id", part.cast("int").alias("part"))


def train_test(strata: DataFrame, ratio: int = 4, seed: str = "tt") -> DataFrame:
    """(fold, instance_id, role), stratified ratio : 1."""
    return allocate(strata, [ratio, 1], seed).select(F.lit(0).alias("fold"), "instance_id", F.when(F.col("part") == 0, "train").otherwise("test").alias("role"))


def cross_validation(strata: DataFrame, folds: int = 10, seed: str = "cv") -> DataFrame:
    """(instance_id, test_fold): each instance is tested once.  Training sets aren't copied: S_train = S_all - S_fold."""
    return allocate(strata, [1.0] * folds, seed).select("instance_id", F.col("part").alias("test_fold"))


def expand_folds(assignment: DataFrame, folds: int) -> DataFrame:
    """(fold, instance_id, role) for all folds, where the copies are really needed."""
    every = F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold")
    return assignment.select(every, "instance_id", "test_fold").select("fold", "instance_id", F.when(F.col("fold") == F.col("test_fold"), "test").otherwise("train").alias("role"))


def learning_curve(strata: DataFrame, test_prop: float = 0.1, parts: int = 10, seed: str = "lc") -> DataFrame:
    """(fold, instance_id, role): one test set, and training sets that grow by a part from fold to fold."""
    if not 0 < test_prop < 1:
        raise ValueError("the test proportion lies between 0 and 1")
    got = allocate(strata, [test_prop] + [(1 - test_prop) / parts] * parts, seed)
    every = F.explode(F.sequence(F.greatest(F.col("part") - 1, F.lit(0)), F.lit(parts - 1))).alias("fold")
    return got.select(every, "instance_id", F.when(F.col("part") == 0, "test").otherwise("train").alias("role"))


def validate_split(names: list[str]) -> str:
    """Which of the three legal shapes a split's part names have: traintest, crossvalidation or learningcurve."""
    s = set(names)
    if {"train", "test"} <= s <= {"train", "test", "unused"}:
        return "traintest"
    if s and all(n.startswith("fold") for n in s):
        return "crossvalidation"
    if "learncurveT" in s and len(s) > 1 and all(n.startswith("learncurve") for n in s):
        return "learningcurve"
    raise ValueError(f"not a split: {sorted(s)}")


def leave_one_domain_out(instances: DataFrame, domain: Column, domains: DataFrame) -> DataFrame:
    """(fold, instance_id, role): each domain is tested once, fold is its name.  `domains`: (domain), a small dimension."""
    rows = instances.select("instance_id", domain.alias("_d")).crossJoin(domains.select(F.col("domain").alias("fold")))
    return rows.select("fold", "instance_id", F.when(F.col("_d") == F.col("fold"), "test").otherwise("train").alias("role"))


def test_class_only(split: DataFrame, class_map: DataFrame) -> DataFrame:
    """Training rows stay only if they have a class that the fold's test part has."""
    labelled = split.join(class_map, "instance_id")
    seen = labelled.where("role = 'test'").select("fold", "label").distinct()
    kept = labelled.where("role = 'train'").join(seen, ["fold", "label"], "left_semi").select("fold", "instance_id", "role").distinct()
    return kept.unionByName(split.where("role = 'test'").select("fold", "instance_id", "role"))


def weighted_choice(items: DataFrame, n: int, seed: str) -> DataFrame:
    """(draw, item): n draws with replacement by weight, `items`: (item, w); all weights zero: uniform.

    Cumulative weights make intervals, looked up by buckets.  A draw has 52 bits.
    """
    whole = items.agg(F.sum("w")).first()[0] or 0
    w = items if whole > 0 else items.withColumn("w", F.lit(1.0))
    total = float(whole if whole > 0 else items.count())
    lo = F.col("lo") / total
    bounds = running_sums(w, [F.col("item")], "w", "lo").select("item", F.round(lo, 12).alias("lo"), F.round(lo + F.col("w") / total, 12).alias("hi"))
    u = F.conv(F.substring(chance(seed, "draw"), 1, 13), 16, 10).cast("double") / 16**13
    draws = items.sparkSession.range(n).withColumnRenamed("id", "draw")
    return looked_up(draws, u, bounds).select("draw", "item")


def cross_domain(train: DataFrame, test: DataFrame) -> DataFrame:
    """(fold, instance_id, role): one dataset trains, another one tests."""
    rows = train.select("instance_id", F.lit("train").alias("role")).unionByName(test.select("instance_id", F.lit("test").alias("role")))
    return rows.select(F.lit(0).alias("fold"), "instance_id", "role")
