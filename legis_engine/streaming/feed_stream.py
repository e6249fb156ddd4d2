"""The change feed as a stream: idempotent logging, counts, and state for late parents."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..commits import CommitLog
from ..session import shared_dir


def source_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files at ``path`` (one file or a folder that files arrive in)."""
    schema = spark.read.parquet(path).schema
    if path.startswith("/") and os.path.isfile(path):
        return spark.readStream.schema(schema).option("pathGlobFilter", os.path.basename(path)).parquet(os.path.dirname(path))
    return spark.readStream.schema(schema).parquet(path)


def run_once(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Everything there is now, written by a query with its checkpoint in the shared folder."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"
    out = f"{base}/out"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{base}/ckpt").outputMode("append")
    else:
        # A complete result replaces the one before, so a repeated batch leaves what the first left.
        q = stream.writeStream.foreachBatch(lambda df, epoch: df.write.mode("overwrite").parquet(out)).option("checkpointLocation", f"{base}/ckpt").outputMode(mode)
    q.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def stream_counts(spark: SparkSession, path: str) -> DataFrame:
    """``event_type, day, n`` with repeated deliveries of an event counted once."""
    events = source_stream(spark, path).select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    once = events.withWatermark("ts", "365 days").dropDuplicates(["event_id", "event_type", "ts"])
    counted = once.groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return run_once(counted, "counts", "complete")


def log_feed(stream: DataFrame, folder: str, checkpoint: str):
    """Feed events appended once: each batch drops what the log has and replaces its own output.

    Of the log only builds in the batch's span of build times are read: ``feed_built_at`` is part of
    an event's key, so no other can repeat one.
    """
    from ..operators.feed import record

    def write(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        log = spark.createDataFrame([], df.schema)
        if CommitLog(spark, folder).children(""):
            held = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(folder).where(F.col("batch") != epoch).drop("batch")
            span = df.agg(F.min("feed_built_at").alias("a"), F.max("feed_built_at").alias("b")).first()
            log = held.where(F.col("feed_built_at").between(span.a, span.b) | F.col("feed_built_at").isNull()) if span.a is not None else held.where("feed_built_at is null")
        record(log, df).write.mode("overwrite").parquet(f"{folder}/batch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
