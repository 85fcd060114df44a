"""Structured Streaming over the append-only evaluation log.

The search appends one JSON object per evaluated candidate. This job tails
that folder and keeps per-block timing statistics (I19's counts and means) up
to date, with its state and offsets in the shared checkpoint folder, so a
restarted or moved driver resumes where it stopped.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import EVAL_LOG_SCHEMA, scratch_dir


def eval_log_stream(spark: SparkSession, path: str) -> DataFrame:
    """Streaming per-block aggregates over an appended evaluation-log folder."""
    log = spark.readStream.schema(EVAL_LOG_SCHEMA).json(path)
    t = log.select(F.explode("timings_s").alias("block", "raw")).withColumn(
        "sec", F.expr("try_cast(raw AS DOUBLE)"))
    return t.groupBy("block").agg(
        F.count("*").alias("n"), F.count_if(F.col("sec").isNull()).cast("bigint").alias("n_non_numeric"),
        F.avg("sec").alias("mean_sec"), F.max("sec").alias("max_sec"))


def run_available(spark: SparkSession, path: str, table: str, checkpoint: str | None = None):
    """Process everything appended so far (availableNow) into a memory table."""
    checkpoint = checkpoint or scratch_dir(spark, "stream-ckpt")
    q = (eval_log_stream(spark, path).writeStream.outputMode("complete").format("memory").queryName(table)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.table(table)
