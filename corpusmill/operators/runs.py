"""Experiments that are run once: results are kept under a hash of their metadata.

A run is looked up before any work starts.  If it is missing, its result is written first and then,
as the commit, its metadata with the time it took; what a broken run left is overwritten.
"""

from __future__ import annotations

import hashlib
import json
import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .metadata import VOLATILE


class Runs:
    """A folder of results; `ran` and `reused` list the hashes of what this object has run and read."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.ran: list[str] = []
        self.reused: list[str] = []

    @staticmethod
    def key(meta: dict[str, str]) -> str:
        """A hash of all entries but the volatile ones, whatever their order."""
        return hashlib.md5(json.dumps(sorted((k, v) for k, v in meta.items() if k not in VOLATILE)).encode()).hexdigest()

    def has(self, meta: dict[str, str]) -> bool:
        try:
            return self.spark.read.schema("result_id string").parquet(f"{self.folder}/runs/{self.key(meta)}").limit(1).count() > 0
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return False

    def result(self, meta: dict[str, str], work) -> DataFrame:
        """The stored result of an experiment; `work`, a function that returns it as a DataFrame, is called only if there is none."""
        key = self.key(meta)
        path = f"{self.folder}/results/{key}"
        if self.has(meta):
            self.reused.append(key)
        else:
            began = time.time()
            work().write.mode("overwrite").parquet(path)
            entries = {**meta, "run_time": f"{time.time() - began:.3f}"}
            row = self.spark.range(1).select(F.lit(key).alias("result_id"), F.create_map(*[F.lit(x) for kv in sorted(entries.items()) for x in kv]).alias("meta"))
            row.write.mode("overwrite").parquet(f"{self.folder}/runs/{key}")
            self.ran.append(key)
        return self.spark.read.parquet(path)

    def committed(self) -> DataFrame:
        """(result_id, meta) of all runs."""
        return self.spark.read.option("recursiveFileLookup", "true").schema("result_id string, meta map<string,string>").parquet(f"{self.folder}/runs")
