"""The folder that driver and executors share, and tables stored in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: folders of this process, by application and the folder they are in
_own: dict[tuple[str, str], str] = {}


def base_dir(spark: SparkSession) -> str:
    """What the session names in spark.checkpoint.dir; where that is unset, on one machine only, a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir().rstrip("/")


def shared_dir(spark: SparkSession) -> str:
    """This application's own folder in base_dir.

    The file system is told to delete it when the driver ends: tables in it are steps of queries,
    and results that are to stay are written elsewhere.
    """
    base, context = base_dir(spark), spark.sparkContext
    at = (context.applicationId, base)
    if at not in _own:
        path = context._jvm.org.apache.hadoop.fs.Path(f"{base}/corpusmill-{uuid.uuid4().hex}")
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _own[at] = path.toString()
    return _own[at]


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """A table that several steps read: written once to the shared folder and read from there.

    Lost executors cost nothing: the files outlive them, and later plans start from the files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
