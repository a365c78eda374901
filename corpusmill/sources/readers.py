"""Sources: files and records to texts (instance_id, text) and class maps (instance_id, label)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lines import name_of, numbered_lines


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.split("path", "/").alias("p"), "content")


def part(k: int) -> Column:
    """k-th last part of a file's path."""
    return F.element_at("p", -k)


def read_dir(spark: SparkSession, path: str, layout: str = "single") -> tuple[DataFrame, dict[str, DataFrame]]:
    """Every file is an instance.  Layouts: single (id = name), classes (class/file, id = class_file), domains (domain/category/file).

    Returns (texts with a binary `bytes` column, class maps by name).
    """
    files = _files(spark, path)
    if layout == "single":
        return files.select(part(1).alias("instance_id"), F.col("content").alias("bytes")), {}
    if layout == "classes":
        rows = files.select(F.concat_ws("_", part(2), part(1)).alias("instance_id"), part(2).alias("label"), F.col("content").alias("bytes"))
        return rows.select("instance_id", "bytes"), {"class": rows.select("instance_id", "label")}
    if layout == "domains":
        rows = files.select(F.concat_ws("-", part(3), part(2), part(1)).alias("instance_id"), part(3).alias("d"), part(2).alias("c"), F.col("content").alias("bytes"))
        maps = {"domain": F.col("d"), "category": F.col("c"), "domain_category": F.concat_ws("-", "d", "c")}
        return rows.select("instance_id", "bytes"), {k: rows.select("instance_id", v.alias("label")) for k, v in maps.items()}
    raise ValueError(layout)


def read_lines_by_class(spark: SparkSession, path: str, folders: bool = False) -> DataFrame:
    """(instance_id, label, text): each line of a file, plain or gzipped, is an instance; the file's name is its class, ids are class-line.

    Large plain files are read in parts.  With `folders`, a folder's files are parts of one, and its name is the class.
    """
    lines = numbered_lines(spark, path, folders=folders).withColumn("label", F.regexp_replace(name_of(F.col("path")), r"\.gz$", ""))
    return lines.where("value <> ''").select(F.concat_ws("-", "label", F.col("line").cast("string")).alias("instance_id"), "label", F.col("value").alias("text"))


def read_jsonl(spark: SparkSession, path: str, text_key: str, class_key: str, folders: bool = False) -> tuple[DataFrame, DataFrame]:
    """(texts, class_map) of JSON lines; the class is a scalar or a list.  Ids: file name and line number; `folders` as in read_lines_by_class."""
    rows = numbered_lines(spark, path, folders=folders).where("trim(value) <> ''")
    rows = rows.select(F.concat_ws("-", name_of(F.col("path")), F.col("line").cast("string")).alias("instance_id"), F.get_json_object("value", f"$.{text_key}").alias("text"), F.get_json_object("value", f"$.{class_key}").alias("c"))
    labels = F.when(F.col("c").startswith("["), F.from_json("c", "array<string>")).when(F.col("c").isNotNull(), F.array("c"))
    return rows.select("instance_id", "text"), rows.select("instance_id", F.explode(labels).alias("label"))


def read_delimited(lines: DataFrame, sep: str, columns: list[str], column: str = "value") -> DataFrame:
    """Lines split at most len(columns) - 1 times: the last column may hold the separator."""
    pieces = F.split(column, re.escape(sep), len(columns))
    return lines.select(*[F.get(pieces, F.lit(i)).alias(c) for i, c in enumerate(columns)])


def read_side_file(spark: SparkSession, path: str, schema: str, sep: str = "\t") -> DataFrame:
    """Labels, encodings or partitions from a csv or tsv with a given schema."""
    return spark.read.csv(path, schema=schema, sep=sep)


def read_paths(lines: DataFrame, column: str = "value") -> DataFrame:
    """(domain, lang, instance_id) from a list of paths."""
    return lines.select(F.split(column, "/").alias("p")).select(part(3).alias("domain"), part(2).alias("lang"), part(1).alias("instance_id"))


def read_tagged(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, class_map, split) from SGML: <REUTERS newid= lewissplit=> blocks with <TOPICS><D>..</D></TOPICS> and <TEXT>.

    Blocks have any number of lines; they are read by their closing mark, so a large file is many tasks.
    """
    blocks = spark.read.option("recursiveFileLookup", "true").option("lineSep", "</REUTERS>").text(path).select(F.regexp_extract("value", r"(?s)<REUTERS.*", 0).alias("b")).where("b <> ''")
    rows = blocks.select(
        F.regexp_extract("b", r'newid="([^"]*)"', 1).alias("instance_id"), F.regexp_extract("b", r'lewissplit="([^"]*)"', 1).alias("part"),
        F.regexp_extract("b", r"(?s)<TEXT[^>]*>(.*?)</TEXT>", 1).alias("text"),
        F.regexp_extract_all(F.regexp_extract("b", r"(?s)<TOPICS>(.*?)</TOPICS>", 1), F.lit("<D>(.*?)</D>"), 1).alias("topics"),
    )
    role = F.when(F.col("part") == "TRAIN", "train").when(F.col("part") == "TEST", "test")
    return rows.select("instance_id", "text"), rows.select("instance_id", F.explode("topics").alias("label")), rows.select(F.lit(0).alias("fold"), "instance_id", role.alias("role")).where("role IS NOT NULL")


def read_xml_index(spark: SparkSession, path: str, row_tag: str, attributes: list[str]) -> dict[str, DataFrame]:
    """Class maps from the attributes of an XML index's elements; a blank attribute is no label."""
    schema = "_id string, " + ", ".join(f"_{a} string" for a in attributes)
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    return {a: rows.select(F.col("_id").alias("instance_id"), F.col(f"_{a}").alias("label")).where("trim(label) <> ''") for a in attributes}


def drop_header(text: Column, lines: int = 5) -> Column:
    """A text without its first lines."""
    pieces = F.split(text, "\n")
    return F.array_join(F.slice(pieces, lines + 1, F.greatest(F.size(pieces) - lines, F.lit(0))), "\n")


def numeric_features(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(instance_id, feature, value) from numeric columns; zeros are absent."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in columns)
    return rows.selectExpr(f"`{key}` as instance_id", f"stack({len(columns)}, {pairs}) as (feature, value)").where("value <> 0")


def repeated_words(words: DataFrame, n: int) -> DataFrame:
    """(instance_id, label, text): word i, with a blank, repeated 1 to n times; the class is the word's."""
    reps = words.sparkSession.range(n).withColumnRenamed("id", "j")
    rows = words.crossJoin(F.broadcast(reps))  # n rows, a parameter
    number = F.col("i") * n + F.col("j")
    return rows.select(F.lpad(number.cast("string"), 8, "0").alias("instance_id"), F.concat(F.lit("class"), F.col("i").cast("string")).alias("label"), F.expr("repeat(concat(word, ' '), cast(j + 1 as int))").alias("text"))


def sorted_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of a folder of text files that are one file in parts."""
    return numbered_lines(spark, path, folders=True).select("line", "value")


def _pairs(text: Column, between: str) -> Column:
    """Array of (idx, value) from pieces such as `idx:value`."""
    pieces = F.filter(F.split(text, " "), lambda x: x != "")
    part = lambda x, k: F.split_part(x, F.lit(between), F.lit(k))
    return F.transform(pieces, lambda x: F.struct(part(x, 1).cast("long").alias("idx"), part(x, 2).cast("double").alias("value")))


def read_libsvm(lines: DataFrame) -> DataFrame:
    """(line, labels, cells) from lines (line, value) `labels idx+1:val ...`; labels -1 are none, indices count from 0."""
    label = F.split_part("value", F.lit(" "), F.lit(1))
    labels = F.when(label == "-1", F.array().cast("array<long>")).otherwise(F.transform(F.split(label, ","), lambda x: x.cast("long")))
    cells = F.transform(_pairs(F.regexp_replace("value", "^[^ ]*", ""), ":"), lambda c: F.struct((c["idx"] - 1).alias("idx"), c["value"].alias("value")))
    return lines.select("line", labels.alias("labels"), cells.alias("cells"))


def read_vw(lines: DataFrame) -> DataFrame:
    """(line, label, cells) from lines (line, value) `label | idx:val ...`; label is null for 0, else counts from 0."""
    label = F.split_part("value", F.lit(" "), F.lit(1)).cast("long")
    return lines.select("line", F.when(label > 0, label - 1).alias("label"), _pairs(F.regexp_replace("value", r"^[^|]*\|", ""), ":").alias("cells"))


def _arff_attributes(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines with the line `start` of @DATA, (line, idx, name) of the attributes after the first)."""
    text = F.trim("value")
    start = lines.where(F.upper(text) == "@DATA").agg(F.min("line").alias("start"))  # one row
    both = lines.crossJoin(F.broadcast(start))
    named = both.where(F.col("line") < F.col("start")).where(F.upper(text).startswith("@ATTRIBUTE"))
    rest = F.trim(F.substring(text, F.lit(11), F.length(text)))
    inside = F.regexp_replace(F.regexp_extract(rest, r"^'((?:[^'\\]|\\.)*)'", 1), r"\\(.)", "$1")
    name = F.when(rest.startswith("'"), inside).otherwise(F.split_part(rest, F.lit(" "), F.lit(1)))
    first = named.agg(F.min("line").alias("first"))
    attributes = named.crossJoin(F.broadcast(first)).where(F.col("line") > F.col("first")).select("line", (F.col("line") - F.col("first") - 1).alias("idx"), name.alias("name"))
    return both, attributes


def read_arff_header(lines: DataFrame) -> DataFrame:
    """(line, value, idx, name): lines (line, value) of an ARFF file up to @DATA; idx and name are null but for the attributes after the first, which is the class."""
    both, attributes = _arff_attributes(lines)
    return both.where(F.col("line") <= F.col("start")).select("line", "value").join(attributes, "line", "left")


def read_arff(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(attributes (idx, name), instances (line, label, cells)) from lines (line, value) of an ARFF file, sparse or dense.

    The first attribute is the class; the others count from 0.  Instances count from 0, after @DATA.
    """
    both, attributes = _arff_attributes(lines)
    text = F.trim("value")
    data = both.where(F.col("line") > F.col("start")).where(~text.startswith("%") & (text != "")).select((F.col("line") - F.col("start") - 1).alias("line"), text.alias("value"))
    sparse = F.col("value").startswith("{")
    inner = F.filter(F.split(F.regexp_replace("value", "^[{]|[}]$", ""), ", *"), lambda x: x != "")
    packed = F.transform(_pairs(F.array_join(F.transform(F.filter(inner, lambda x: ~x.startswith("0 ")), lambda x: F.replace(x, F.lit(" "), F.lit(":"))), " "), ":"), lambda c: F.struct((c["idx"] - 1).alias("idx"), c["value"].alias("value")))
    pieces = F.split("value", ",")
    full = F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), lambda x, i: F.struct(i.cast("long").alias("idx"), x.cast("double").alias("value")))
    label = F.when(sparse, F.split_part(F.get(inner, F.lit(0)), F.lit(" "), F.lit(2))).otherwise(F.get(pieces, F.lit(0)))
    return attributes.drop("line"), data.select("line", label.alias("label"), F.when(sparse, packed).otherwise(F.filter(full, lambda c: c["value"] != 0)).alias("cells"))
