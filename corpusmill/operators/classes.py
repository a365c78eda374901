"""Class maps: long tables (instance_id, label), any number of rows for each instance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "UNKNOWN"


def to_indicator(class_map: DataFrame, instances: DataFrame, labels: list[str]) -> DataFrame:
    """One row for each instance, one 0/1 column for each label."""
    ones = class_map.groupBy("instance_id").agg(*[F.max(F.when(F.col("label") == x, 1).otherwise(0)).alias(x) for x in labels])
    return instances.select("instance_id").join(ones, "instance_id", "left").na.fill(0, labels)


def from_indicator(df: DataFrame, labels: list[str]) -> DataFrame:
    pairs = F.filter(F.array(*[F.when(F.col(x) == 1, F.lit(x)) for x in labels]), lambda x: x.isNotNull())
    return df.select("instance_id", F.explode(pairs).alias("label"))


def superfluous(class_map: DataFrame, class_space: DataFrame) -> DataFrame:
    """Labels outside the declared space; none if the map is valid."""
    return class_map.select("label").distinct().join(class_space, "label", "left_anti")


def distribution(class_map: DataFrame, class_space: DataFrame) -> DataFrame:
    """(label, n) for every label of the space."""
    counts = class_map.groupBy("label").agg(F.count("*").alias("n"))
    return class_space.select("label").join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def recode(class_map: DataFrame, mapping: DataFrame) -> DataFrame:
    """Labels by a table (label, new); those that aren't in it become UNKNOWN."""
    return class_map.join(mapping, "label", "left").select("instance_id", F.coalesce("new", F.lit(UNKNOWN)).alias("label"))


def recode_pattern(class_map: DataFrame) -> DataFrame:
    """Codes such as en or en-GB become their two letters, others UNKNOWN."""
    code = F.regexp_extract("label", r"^(\w\w)(-\w+)?$", 1)
    return class_map.select("instance_id", F.when(code == "", UNKNOWN).otherwise(code).alias("label"))


def drop_small(class_map: DataFrame, threshold: int = 10) -> DataFrame:
    """Without the labels of fewer than `threshold` instances; an aggregate and a semi-join, so a huge class is no hot window."""
    large = class_map.groupBy("label").agg(F.count("*").alias("_n")).where(F.col("_n") >= threshold)
    return class_map.join(large, "label", "left_semi")


def is_one_of_m(class_map: DataFrame, instances: DataFrame) -> DataFrame:
    """One row: does every instance have exactly one label?"""
    n = class_map.groupBy("instance_id").agg(F.count("*").alias("n"))
    return instances.select("instance_id").join(n, "instance_id", "left").agg(F.coalesce(F.bool_and(F.coalesce(F.col("n"), F.lit(0)) == 1), F.lit(True)).alias("one_of_m"))


def strata(instances: DataFrame, class_map: DataFrame) -> DataFrame:
    """(instance_id, stratum): the set of an instance's labels; the empty set is a stratum."""
    sets = class_map.groupBy("instance_id").agg(F.array_join(F.array_sort(F.collect_set("label")), "|").alias("stratum"))
    return instances.select("instance_id").join(sets, "instance_id", "left").select("instance_id", F.coalesce("stratum", F.lit("")).alias("stratum"))
