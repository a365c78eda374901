"""Result metadata: (result_id, meta map<string, string>) and what is asked of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: keys that differ between runs of the same experiment
VOLATILE = ("uuid", "date", "learn_time", "classify_time")


def find(meta: DataFrame, desired: dict[str, str | None]) -> DataFrame:
    """Rows whose metadata have the wanted values; a wanted None matches an absent key."""
    for k, v in desired.items():
        got = F.try_element_at("meta", F.lit(k))
        meta = meta.where(got.isNull() if v is None else got == v)
    return meta


def find_one(meta: DataFrame, desired: dict[str, str | None]) -> str:
    """The one matching result_id, else an error."""
    found = find(meta, desired).select("result_id").limit(2).collect()
    if len(found) != 1:
        raise LookupError(f"{'no' if not found else 'more than one'} result matches {desired}")
    return found[0][0]


def value_counts(meta: DataFrame, least: int = 2, most: int = 10) -> DataFrame:
    """(key, value, n) of the keys that have between `least` and `most` distinct values."""
    rows = meta.select(F.explode("meta").alias("key", "value")).groupBy("key", "value").agg(F.count("*").alias("n"))
    keys = rows.groupBy("key").agg(F.count("*").alias("d")).where(F.col("d").between(least, most))
    return rows.join(keys, "key", "left_semi")


def shared(meta: DataFrame) -> DataFrame:
    """(key, value) that all results have in common."""
    n = meta.agg(F.count("*").alias("total"))
    rows = meta.select(F.explode("meta").alias("key", "value")).groupBy("key", "value").agg(F.count("*").alias("n"))
    return rows.crossJoin(n).where("n = total").select("key", "value")


def differing(meta: DataFrame) -> DataFrame:
    """(key, result_id, value): the entries of keys in which the results differ; a result that lacks such a key has a null value."""
    ids = meta.select("result_id")
    rows = meta.select("result_id", F.explode("meta").alias("key", "value"))
    keys = rows.join(shared(meta).select("key"), "key", "left_anti").select("key").distinct()
    # keys are few
    return ids.crossJoin(F.broadcast(keys)).join(rows, ["result_id", "key"], "left").select("key", "result_id", "value")


def identity(meta: DataFrame) -> DataFrame:
    """`meta` with a hash of all entries but the volatile ones."""
    kept = F.map_filter("meta", lambda k, v: ~k.isin(*VOLATILE))
    return meta.withColumn("hash", F.md5(F.to_json(F.array_sort(F.map_entries(kept)))))


def merge(dst: DataFrame, src: DataFrame) -> DataFrame:
    """dst and those results of src whose metadata it doesn't have, timings and ids aside."""
    new = identity(src).join(identity(dst).select("hash"), "hash", "left_anti").drop("hash")
    return dst.unionByName(new.select(dst.columns))


def missing(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Experiments still to run: wanted ones with no stored result of the same metadata."""
    return identity(wanted).join(identity(stored).select("hash"), "hash", "left_anti").drop("hash")
