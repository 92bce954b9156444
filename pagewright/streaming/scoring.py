"""Scoring predictions as their files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import metrics
from pagewright.functions.layout import stem


def prediction_stream(spark: SparkSession, folder: str, ending: str = "md", files_per_batch: int = 1000) -> DataFrame:
    """Page texts of files that arrive in a folder."""
    read = spark.readStream.schema("value string").option("wholetext", True).option("pathGlobFilter", f"*.{ending}").option("maxFilesPerTrigger", files_per_batch)
    return read.format("text").load(folder).select(stem(F.col("_metadata.file_name")).alias("page_id"), F.col("value").alias("text"))


def score_stream(predictions: DataFrame, gt: DataFrame) -> DataFrame:
    """Scores of arriving pages against a static ground truth; needs no state and no watermark."""
    both = predictions.select("page_id", F.col("text").alias("pred")).join(gt.select("page_id", F.col("text").alias("gt")), "page_id")
    return both.select("page_id", metrics.cer(F.col("pred"), F.col("gt")).alias("cer"), metrics.bleu(F.col("pred"), F.col("gt")).alias("bleu"))


def write_scores(scores: DataFrame, folder: str, checkpoint: str, once: bool = False):
    """Append scores; a rerun goes on where the checkpoint stands, so no page is scored twice."""
    out = scores.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if once else out).start()
