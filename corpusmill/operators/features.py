"""Feature maps: long tables (instance_id, feature, value) of non-zero values."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import row_numbers

MAX_FEATURES = 50_000


def feature_counts(texts: DataFrame, tokens: Column, key: str = "doc_id") -> DataFrame:
    """How often each token occurs in each instance.  One explode and one aggregation with partial sums."""
    rows = texts.select(F.col(key).alias("instance_id"), F.explode(tokens).alias("feature"))
    return rows.groupBy("instance_id", "feature").agg(F.count("*").alias("value"))


def _gram_rows(n: int):
    digits = np.frombuffer("".join(f"{b:02X}" for b in range(256)).encode(), np.uint8).reshape(256, 2)

    def run(batches):
        for batch in batches:
            at, codes, counts = [], [], []
            for i, data in enumerate(batch.column(1)):
                b = np.frombuffer(data.as_buffer() or b"", np.uint8).astype(np.uint16 if n <= 2 else np.int64)
                if len(b) < n:
                    continue
                code = b[: len(b) - n + 1]
                for k in range(1, n):
                    code = code << 8 | b[k : len(b) - n + 1 + k]
                code = np.sort(code, kind="stable")
                first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
                at.append(np.full(len(first), i))
                codes.append(code[first])
                counts.append(np.diff(first, append=len(code)))
            if not at:
                continue
            at, codes, counts = np.concatenate(at), np.concatenate(codes).astype(np.int64), np.concatenate(counts)
            for s in range(0, len(at), 1 << 17):
                code = codes[s : s + (1 << 17)]
                hexed = np.stack([digits[code >> 8 * k & 255] for k in reversed(range(n))], axis=1).tobytes()
                names = pa.StringArray.from_buffers(len(code), pa.py_buffer(np.arange(len(code) + 1, dtype=np.int32) * 2 * n), pa.py_buffer(hexed))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[s : s + (1 << 17)])), names, pa.array(counts[s : s + (1 << 17)])], ["instance_id", "feature", "value"])

    return run


def byte_gram_counts(texts: DataFrame, n: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """feature_counts of byte n-grams (n up to 7), counted in a text's row as numbers: an explode would make a row of each place.

    All rows of an instance lie together, so sums by instance are nearly whole before they are shuffled.
    """
    rows = texts.select(F.col(key).alias("instance_id"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("data"))
    counts = rows.mapInArrow(_gram_rows(n), f"instance_id {rows.schema['instance_id'].dataType.simpleString()}, feature string, value long")
    # rows that share an id are one instance
    return counts.repartition("instance_id").groupBy("instance_id", "feature").agg(F.sum("value").alias("value"))


def feature_sequence(texts: DataFrame, values: Column, key: str = "doc_id") -> DataFrame:
    """An array of numbers as features feat1, feat2 and so on; zeros are absent."""
    rows = texts.select(F.col(key).alias("instance_id"), F.posexplode(values).alias("p", "value"))
    return rows.where("value <> 0").select("instance_id", F.concat(F.lit("feat"), F.col("p") + 1).alias("feature"), F.col("value").cast("double").alias("value"))


def index_features(features: DataFrame, space: DataFrame | None = None) -> DataFrame:
    """(feature, idx): the space, extended.  Old indices stay, new features follow in order of name."""
    new = features.select("feature").distinct()
    if space is None:
        return row_numbers(new, [F.col("feature")]).select("feature", (F.col("rn") - 1).cast("long").alias("idx"))
    top = space.agg(F.coalesce(F.max("idx"), F.lit(-1)).alias("top"))
    fresh = row_numbers(new.join(space, "feature", "left_anti"), [F.col("feature")]).crossJoin(F.broadcast(top))  # one row
    return space.select("feature", "idx").unionByName(fresh.select("feature", (F.col("top") + F.col("rn")).cast("long").alias("idx")))


def cull(features: DataFrame, max_feats: int = MAX_FEATURES) -> DataFrame:
    """Only the features with the largest totals; a space of at most `max_feats` stays whole."""
    top = features.groupBy("feature").agg(F.sum("value").alias("_total")).orderBy(F.desc("_total"), "feature").limit(max_feats)
    # proven bound: max_feats rows
    return features.join(F.broadcast(top.select("feature")), "feature", "left_semi").select(features.columns)


def union_spaces(spaces: dict[str, DataFrame]) -> DataFrame:
    """Columns of several spaces side by side: features are prefixed by their space."""
    parts = [f.select("instance_id", F.concat(F.lit(f"{name}:"), "feature").alias("feature"), F.col("value").cast("double").alias("value")) for name, f in sorted(spaces.items())]
    return reduce(DataFrame.unionByName, parts)


def stack(datasets: dict[str, DataFrame]) -> DataFrame:
    """Rows of several datasets under one space: ids are prefixed by their dataset."""
    parts = [f.withColumn("instance_id", F.concat(F.lit(f"{name}-"), F.col("instance_id").cast("string"))) for name, f in sorted(datasets.items())]
    return reduce(DataFrame.unionByName, parts)


def merge_spaces(dst: DataFrame, src: DataFrame) -> DataFrame:
    """Indices of a merged space: dst's stay, src's new labels follow sorted."""
    return index_features(src.select("feature"), dst)


def id_differences(features: DataFrame, instances: DataFrame) -> DataFrame:
    """(instance_id, side): ids in one of the two only; none if they agree."""
    a, b = features.select("instance_id").distinct(), instances.select("instance_id").distinct()
    return a.join(b, "instance_id", "left_anti").select("instance_id", F.lit("features").alias("side")).unionByName(
        b.join(a, "instance_id", "left_anti").select("instance_id", F.lit("instances").alias("side"))
    )


def multiset(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Multisets (key, n): add, subtract (positive results), union (larger count) or intersect (smaller count)."""
    x, y = a.select("key", F.col("n").alias("na")), b.select("key", F.col("n").alias("nb"))
    na, nb = F.coalesce("na", F.lit(0)), F.coalesce("nb", F.lit(0))
    value = {"add": na + nb, "subtract": na - nb, "union": F.greatest(na, nb), "intersect": F.least(na, nb)}[how]
    return x.join(y, "key", "full").select("key", value.cast("long").alias("n")).where("n > 0")


def most_common(a: DataFrame, n: int) -> DataFrame:
    return a.orderBy(F.desc("n"), "key").limit(n)


def invert(df: DataFrame, key: str, values: str, chunk: int = 100_000) -> DataFrame:
    """(value, part, keys): from key -> array of values; keys are sorted, at most `chunk` in a row, and part counts a value's rows from 0."""
    rows = df.select(key, F.explode(values).alias("value")).distinct()
    placed = row_numbers(rows, [F.col(key)], ["value"]).withColumn("part", F.floor((F.col("rn") - 1) / chunk).cast("int"))
    return placed.groupBy("value", "part").agg(F.array_sort(F.collect_list(key)).alias("keys"))


def stats(features: DataFrame, instances: DataFrame, bins: int = 100) -> DataFrame:
    """One row: sizes of the space, and mean and population deviation of feature totals and document sizes."""
    by_feature = features.groupBy("feature").agg(F.sum("value").alias("t"))
    by_doc = instances.select("instance_id").join(features.groupBy("instance_id").agg(F.sum("value").alias("t")), "instance_id", "left").select(F.coalesce("t", F.lit(0)).alias("t"))
    one = by_feature.agg(F.count("*").alias("n_features"), F.avg("t").alias("feature_mean"), F.stddev_pop("t").alias("feature_std"))
    two = by_doc.agg(F.count("*").alias("n_docs"), F.avg("t").alias("doc_mean"), F.stddev_pop("t").alias("doc_std"))
    three = features.agg(F.count("*").alias("n_nonzero"))
    return one.crossJoin(two).crossJoin(three)  # one row each


def totals_histogram(features: DataFrame, bins: int = 100, by: str = "feature") -> DataFrame:
    """(bin, n): histogram of the totals of features (or, by instance_id, of instances) in equal bins from the smallest to the largest."""
    totals = features.groupBy(by).agg(F.sum("value").cast("double").alias("t"))
    ends = totals.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    where = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col("t") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))))).otherwise(0)
    return totals.crossJoin(ends).groupBy(where.cast("int").alias("bin")).agg(F.count("*").alias("n"))
