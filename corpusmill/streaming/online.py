"""Scoring new texts with a stored model, in batches or as a stream.

The model is a parquet table with a row for each feature: its logarithms by class in an array.
Texts are tokenised with the training features only; a text is scored inside a micro-batch, so the
stream keeps no state and needs no watermark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import classify as cf
from ..operators import evaluate as ev
from ..operators import features as fm


def save_model(model: tuple[DataFrame, DataFrame], path: str) -> None:
    cells, classes = model
    cells.write.parquet(f"{path}/cells")
    classes.write.parquet(f"{path}/classes")


def load_model(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/cells"), spark.read.parquet(f"{path}/classes")


def classify_texts(model: tuple[DataFrame, DataFrame], texts: DataFrame, tokens: Column, key: str = "doc_id", counts: DataFrame | None = None) -> DataFrame:
    """(instance_id, label) for texts; those without any token get the most likely class.  `counts`: feature_counts of the texts, if there are any yet."""
    counts = fm.feature_counts(texts, tokens, key) if counts is None else counts
    found = ev.highest(cf.nb_predict(model, counts), ["instance_id"]).withColumnRenamed("instance_id", "_id")
    likely = ev.highest(model[1].select(F.lit(0).alias("_all"), "label", F.col("prior").alias("score")), ["_all"]).select(F.col("label").alias("_likely"))
    every = texts.select(F.col(key).alias("instance_id")).distinct().join(found, F.col("instance_id").eqNullSafe(F.col("_id")), "left")
    return every.crossJoin(F.broadcast(likely)).select("instance_id", F.coalesce("label", "_likely").alias("label"))  # one row


def classify_stream(model_path: str, stream: DataFrame, tokens: Column, out: str, checkpoint: str, key: str = "doc_id"):
    """Start a query that classifies each micro-batch and appends it to parquet; a batch that is run again overwrites its own folder."""

    def score(batch: DataFrame, number: int) -> None:
        model = load_model(batch.sparkSession, model_path)
        classify_texts(model, batch, tokens, key).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
