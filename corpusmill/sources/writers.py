"""Sinks: text files in other tools' formats, written by many tasks as ranges of one sorted file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_sorted(rows: DataFrame, path: str, order: list[str], folders: list[str] | None = None) -> None:
    """Column `value` of the rows as text files whose lines, in order of file name, are in the given order.

    Ranges are written by many tasks, each its own file, and Spark commits them together: what a lost
    executor began isn't seen.  With `folders`, a folder for each value of these columns, which `order` must begin with.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    writer = ranged.select(*(folders or []), "value").write
    (writer.partitionBy(*folders) if folders else writer).text(path)


def _cells(features: DataFrame, space: DataFrame, base: int, between: str = ":", sep: str = " ") -> DataFrame:
    """(instance_id, cells): idx:value of an instance, ascending."""
    rows = features.join(space, "feature").select("instance_id", (F.col("idx") + base).alias("i"), F.col("value").cast("string").alias("v"))
    cells = F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: F.concat(x["i"].cast("string"), F.lit(between), x["v"]))
    return rows.groupBy("instance_id").agg(F.array_join(cells, sep).alias("cells"))


def _labels(class_map: DataFrame, classes: DataFrame) -> DataFrame:
    rows = class_map.join(F.broadcast(classes), "label")  # a closed class space
    return rows.groupBy("instance_id").agg(F.array_sort(F.collect_list("idx")).alias("l"))


def libsvm_rows(instances: DataFrame, features: DataFrame, space: DataFrame, class_map: DataFrame, classes: DataFrame) -> DataFrame:
    """(instance_id, value): `labels idx+1:val ...`; labels joined by commas, -1 for none."""
    rows = instances.select("instance_id").join(_labels(class_map, classes), "instance_id", "left").join(_cells(features, space, 1), "instance_id", "left")
    label = F.coalesce(F.array_join(F.transform("l", lambda x: x.cast("string")), ","), F.lit("-1"))
    return rows.select("instance_id", F.rtrim(F.concat_ws(" ", label, F.coalesce("cells", F.lit("")))).alias("value"))


def vw_rows(instances: DataFrame, features: DataFrame, space: DataFrame, class_map: DataFrame, classes: DataFrame) -> DataFrame:
    """(instance_id, value): `label | idx:val ...`; labels from 1, 0 for none; more than one label is an error."""
    rows = instances.select("instance_id").join(_labels(class_map, classes), "instance_id", "left").join(_cells(features, space, 0), "instance_id", "left")
    one = F.when(F.coalesce(F.size("l"), F.lit(0)) > 1, F.raise_error(F.lit("more than one label")).cast("long")).otherwise(F.coalesce(F.get("l", F.lit(0)) + 1, F.lit(0)))
    return rows.select("instance_id", F.rtrim(F.concat_ws(" | ", one.cast("string"), F.coalesce("cells", F.lit("")))).alias("value"))


def _one_label(instances: DataFrame, class_map: DataFrame) -> DataFrame:
    """(instance_id, label); none or more than one is an error."""
    labels = class_map.groupBy("instance_id").agg(F.count("*").alias("k"), F.min("label").alias("label"))
    rows = instances.select("instance_id").join(labels, "instance_id", "left")
    return rows.select("instance_id", F.when(F.col("k") == 1, F.col("label")).otherwise(F.raise_error(F.lit("an instance has not exactly one label")).cast("string")).alias("label"))


def quoted(name: Column) -> Column:
    """A name in single quotes."""
    return F.concat(F.lit("'"), F.replace(F.replace(name, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))


def arff_rows(instances: DataFrame, features: DataFrame, space: DataFrame, class_map: DataFrame, dense: bool = False) -> DataFrame:
    """(instance_id, value): sparse data rows `{0 class, i+1 value}`, or dense ones `class,value,value...`."""
    rows = _one_label(instances, class_map)
    if not dense:
        rows = rows.join(_cells(features, space, 1, " ", ", "), "instance_id", "left")
        return rows.select("instance_id", F.concat(F.lit("{0 "), "label", F.coalesce(F.concat(F.lit(", "), "cells"), F.lit("")), F.lit("}")).alias("value"))
    size = space.agg(F.count("*").alias("v"))
    own = features.join(space, "feature").groupBy("instance_id").agg(F.array_sort(F.collect_list(F.struct("idx", F.col("value").cast("string").alias("v")))).alias("c"))

    def zeros(n: Column) -> Column:
        return F.repeat(F.lit(",0"), n.cast("int"))

    # zeros fill the gap before each cell and after the last
    before = lambda i: F.when(i > 0, F.get("c", i - 1)["idx"]).otherwise(-1)
    filled = F.array_join(F.transform("c", lambda x, i: F.concat(zeros(x["idx"] - before(i) - 1), F.lit(","), x["v"])), "")
    last = F.coalesce(F.get("c", F.size("c") - 1)["idx"], F.lit(-1))
    rows = rows.join(own, "instance_id", "left").crossJoin(F.broadcast(size))  # one row
    return rows.select("instance_id", F.concat("label", F.coalesce(filled, F.lit("")), zeros(F.col("v") - last - 1)).alias("value"))


def arff_header(space: DataFrame, classes: DataFrame, relation: str = "corpus") -> DataFrame:
    """(line, value) of the header, from @RELATION to @DATA."""
    fixed = F.array(*[F.struct(F.lit(n).cast("long").alias("line"), F.lit(x).alias("value")) for n, x in ((-3, f"@RELATION '{relation}'"), (-2, ""), (2**62, ""), (2**62 + 1, "@DATA"))])
    around = space.sparkSession.range(1).select(F.inline(fixed))
    # a closed class space
    names = classes.agg(F.concat(F.lit("@ATTRIBUTE class {"), F.array_join(F.array_sort(F.collect_list("label")), ","), F.lit("}")).alias("value")).select(F.lit(-1).cast("long").alias("line"), "value")
    each = space.select(F.col("idx").alias("line"), F.concat(F.lit("@ATTRIBUTE "), quoted(F.col("feature")), F.lit(" NUMERIC")).alias("value"))
    return around.unionByName(names).unionByName(each)


def density(instances: DataFrame, features: DataFrame) -> DataFrame:
    """One row: share of non-zero cells; up to 0.10 rows are written sparse."""
    n = instances.agg(F.count("*").alias("n"))
    return features.agg(F.count("*").alias("cells"), F.countDistinct("feature").alias("k")).crossJoin(n).select((F.col("cells") / (F.col("n") * F.col("k"))).alias("density"))


def write_arff(instances: DataFrame, features: DataFrame, space: DataFrame, class_map: DataFrame, classes: DataFrame, path: str, relation: str = "corpus", threshold: float = 0.10) -> None:
    """Header and data rows by instance; sparse rows up to a density of `threshold`, else dense ones."""
    share = density(instances, features).first().density  # one number
    data = arff_rows(instances, features, space, class_map, share is not None and share > threshold)
    head = arff_header(space, classes, relation)
    lines = head.select(F.lit(0).alias("section"), "line", "value").unionByName(data.select(F.lit(1).alias("section"), F.col("instance_id").alias("line"), "value"))
    write_sorted(lines, path, ["section", "line"])


def bow_rows(features: DataFrame, space: DataFrame, class_map: DataFrame) -> DataFrame:
    """(instance_id, label, value): `id class  featN count ...`, a line for each class of an instance; a negative or broken count is an error."""
    whole = F.when((F.col("value") >= 0) & (F.col("value") == F.floor("value")), F.col("value").cast("long")).otherwise(F.raise_error(F.lit("a count is negative or no whole number")).cast("long"))
    rows = features.join(space, "feature").select("instance_id", "idx", whole.alias("v")).where("v > 0")
    cells = F.transform(F.array_sort(F.collect_list(F.struct("idx", "v"))), lambda x: F.concat(F.lit("feat"), x["idx"].cast("string"), F.lit(" "), x["v"].cast("string")))
    lines = rows.groupBy("instance_id").agg(F.array_join(cells, " ").alias("cells")).join(class_map, "instance_id")
    return lines.select("instance_id", "label", F.concat(F.col("instance_id").cast("string"), F.lit(" "), "label", F.lit("  "), "cells").alias("value"))


def sequence_rows(threads: DataFrame, value_columns: list[str], label: str) -> DataFrame:
    """(thread_id, end, pos, value): a line of values and label for each instance, and a blank one at the end of each thread.

    In order of the first three columns they are the file; a thread of any length is many rows.
    """
    line = F.concat_ws(" ", *[F.col(c).cast("string") for c in [*value_columns, label]])
    rows = threads.select("thread_id", F.lit(0).alias("end"), "pos", line.alias("value"))
    return rows.unionByName(threads.groupBy("thread_id").agg(F.max("pos").alias("pos")).select("thread_id", F.lit(1).alias("end"), "pos", F.lit("").alias("value")))


def write_features(features: DataFrame, path: str, dataset: str, space: str) -> None:
    features.withColumn("dataset", F.lit(dataset)).withColumn("space", F.lit(space)).write.mode("append").partitionBy("dataset", "space").parquet(path)


def write_results(predictions: DataFrame, gold: DataFrame, path: str) -> None:
    """Scores and gold standard, each partitioned by result_id."""
    predictions.write.mode("append").partitionBy("result_id").parquet(f"{path}/predictions")
    gold.write.mode("append").partitionBy("result_id").parquet(f"{path}/gold")


def write_summary(table: DataFrame, path: str, columns: list[str]) -> None:
    """Chosen columns as CSV with a header; missing values read UNKNOWN."""
    table.select(*[F.coalesce(F.col(c).cast("string"), F.lit("UNKNOWN")).alias(c) for c in columns]).write.csv(path, header=True)
