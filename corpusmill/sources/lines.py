"""Numbered lines of large files, read in parts.

Spark splits a text file into blocks and reads each in a task, so no task sees a line's number.
Lines are stored with their block (file and first byte) and their place in the task; lines by block
are counted, running sums over a file's blocks give each block its first number, and a line's number
is that plus its place in the block.  Lines are never shuffled if the list of blocks is small enough
for a broadcast; a compressed file is one block.

Blocks and places are read from the stored rows only, so it doesn't matter if Spark would cut the
files otherwise when it reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import stored


def numbered_lines(spark: SparkSession, path: str, end: str = "\n", folders: bool = False) -> DataFrame:
    """(path, line, value): lines of the files in a folder and below it, numbered from 0 in each file.

    `end` is what ends a line, and may be any string, so records of several lines are read by their
    closing mark (which the value then lacks).  With `folders`, the files of a folder are parts of one, in
    order of name, as Spark writes them, and path is the folder.  Blank lines count.
    """
    raw = spark.read.option("recursiveFileLookup", "true").option("lineSep", end).text(path)
    file = F.col("_metadata.file_path")
    rows = stored(raw.select(file.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value"))
    # a task reads a block from its start to its end, so its lines' places follow each other
    blocks = rows.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    unit = F.regexp_replace("file", "/[^/]*$", "") if folders else F.col("file")
    blocks = blocks.withColumn("path", unit)
    before = F.sum("n").over(Window.partitionBy("path").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1))
    starts = blocks.select("file", "block", "path", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    return rows.join(starts, ["file", "block"]).select("path", (F.col("at") + F.col("shift")).alias("line"), "value")


def name_of(path) -> F.Column:
    """The last part of a path, decoded as Spark encodes it in file names."""
    return F.url_decode(F.element_at(F.split(path, "/"), -1))
