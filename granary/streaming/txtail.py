"""An extension: a transaction log that is still being written, followed with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.txlog import SCHEMA, with_page


def tail(spark: SparkSession, folder: str) -> DataFrame:
    """New entries of the JSON-lines files of a folder."""
    return with_page(spark.readStream.schema(SCHEMA).json(folder).withColumn("at", F.timestamp_micros((F.col("ts") * 1_000_000).cast("long"))))


def contended_pages(log: DataFrame, late: str = "1 minute", window: str = "10 seconds") -> DataFrame:
    """Pages that several transactions lock within a window, one of them exclusively."""
    locks = log.where(F.col("op").isin("LOCK_S", "LOCK_X") & F.col("page").isNotNull()).withWatermark("at", late)
    found = locks.groupBy(F.window("at", window), "page").agg(F.count("*").alias("n_locks"), F.approx_count_distinct("tx_id").alias("n_tx"), F.bool_or(F.col("op") == "LOCK_X").alias("exclusive"))
    return found.where("n_tx > 1 AND exclusive").select("window.start", "page", "n_locks", "n_tx")
