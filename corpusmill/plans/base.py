"""How queries are registered, and the SQL that oracles share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import features as fm
from ..operators import splits as sp
from ..shared import shared_dir, stored

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The driver's tables, and the canonical ones made from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def instances(self) -> DataFrame:
        return self.documents.select(F.col("doc_id").alias("instance_id"))

    def langs(self) -> DataFrame:
        return self.documents.select(F.col("doc_id").alias("instance_id"), F.col("lang").alias("label"))

    def sources(self) -> DataFrame:
        return self.documents.select(F.col("doc_id").alias("instance_id"), F.col("source").alias("label"))

    def multilabel(self) -> DataFrame:
        pairs = F.filter(F.array(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic")), lambda x: x.isNotNull())
        return self.labels.select(F.col("doc_id").alias("instance_id"), F.explode(pairs).alias("label"))

    def words(self) -> DataFrame:
        return fm.feature_counts(self.documents, tx.bow(F.col("text")))

    def bigrams(self) -> DataFrame:
        return fm.byte_gram_counts(self.documents, 2)

    def strata(self) -> DataFrame:
        return self.langs().select("instance_id", F.col("label").alias("stratum"))

    def folds(self, k: int = 10) -> DataFrame:
        return sp.cross_validation(self.strata(), k)

    def train_test(self) -> DataFrame:
        return sp.train_test(self.strata())

    def scratch(self) -> str:
        """A new folder that driver and executors share."""
        return f"{shared_dir(self.spark)}/scratch-{uuid.uuid4().hex}"

    def stored(self, table: DataFrame) -> DataFrame:
        """A feature table that several steps read: written once to the shared folder, and read from there."""
        return stored(table)

    def checkpointing(self) -> None:
        shared_dir(self.spark)


def q(name: str, sql: str | None = None, once: bool = False):
    """Register a function of Tables as a query, with its SQL."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            # tables that several others use are computed once
            ORACLES[name] = re.sub(r"(\w) AS \(SELECT", r"\1 AS MATERIALIZED (SELECT", sql) if once else sql
        return f

    return add


P = tx.PUNCTUATION.replace("'", "''")
B = r"[ \t\n\r\f\x0B]+"


def split_sql(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '{B}'), lambda t: t <> '')"


BOW = split_sql(f"translate(lower(coalesce(text, '')), '{P}', '')")
#: w(doc_id, w): bag-of-words tokens
W = f"w AS (SELECT doc_id, {BOW} AS w FROM documents)"
#: f(instance_id, feature, value): their counts
FW = f"{W}, f AS (SELECT doc_id AS instance_id, feature, count(*) AS value FROM (SELECT doc_id, unnest(w) AS feature FROM w) GROUP BY ALL)"
#: b(instance_id, feature, value): byte bigrams
FB = "b AS (SELECT doc_id AS instance_id, h[i] || h[i + 1] AS feature, count(*) AS value FROM (SELECT doc_id, h, unnest(generate_series(1, len(h) - 1)) AS i FROM (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS h FROM documents)) GROUP BY ALL)"
ML = "ml AS (SELECT doc_id AS instance_id, 'quality' AS label FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1)"
LANG = "cm AS (SELECT doc_id AS instance_id, lang AS label FROM documents)"
STRATA = "strata AS (SELECT doc_id AS instance_id, lang AS stratum FROM documents)"


def alloc_sql(weights, seed: str, strata: str = "strata", out: str = "alloc") -> str:
    """CTEs that end in `out`(instance_id, stratum, part)."""
    total = float(sum(weights))
    values = ", ".join(f"({i}, {w / total!r}::DOUBLE)" for i, w in enumerate(weights))
    return f"""{out}_rk AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(concat_ws('|', '{seed}', instance_id::VARCHAR)), instance_id) AS rn, count(*) OVER (PARTITION BY stratum) AS n FROM {strata}),
    {out}_pt AS (SELECT stratum, n, part, floor(w * n + 1e-9)::BIGINT AS base FROM (SELECT DISTINCT stratum, n FROM {out}_rk), (VALUES {values}) p(part, w)),
    {out}_ps AS (SELECT *, base + CASE WHEN row_number() OVER (PARTITION BY stratum ORDER BY md5(concat_ws('|', '{seed}', stratum, part::VARCHAR)), part) <= n - sum(base) OVER (PARTITION BY stratum) THEN 1 ELSE 0 END AS size FROM {out}_pt),
    {out}_pe AS (SELECT stratum, sum(size) OVER (PARTITION BY stratum ORDER BY part) AS hi FROM {out}_ps),
    {out} AS (SELECT r.instance_id, r.stratum, CAST(count(*) FILTER (WHERE e.hi < r.rn) AS INTEGER) AS part FROM {out}_rk r JOIN {out}_pe e ON e.stratum = r.stratum GROUP BY ALL)"""


def folds_sql(k: int = 10) -> str:
    """CTEs that end in folds(instance_id, test_fold)."""
    return f"{STRATA}, {alloc_sql([1.0] * k, 'cv')}, folds AS (SELECT instance_id, part AS test_fold FROM alloc)"


TT = f"{STRATA}, {alloc_sql([4, 1], 'tt')}, tt AS (SELECT 0 AS fold, instance_id, CASE WHEN part = 0 THEN 'train' ELSE 'test' END AS role FROM alloc)"
