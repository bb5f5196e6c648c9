"""Micro-batch consumers and windowed streams over the event log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mnemolith.functions import text as T


def log_stream(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """The event log as a stream of files."""
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", max_files) if max_files else r).parquet(path)


def consume(stream: DataFrame, process: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, trigger: str | None = None) -> StreamingQuery:
    """Run a processor over every micro-batch; its output goes to a folder per batch id, so a repeated batch overwrites.

    Each consumer has its own checkpoint, which stands for its consumption marks: late rows are simply new ones.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id:08d}")

    w = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=trigger) if trigger else w.trigger(availableNow=True)).start()


def first_contents(stream: DataFrame, ts: str = "ingested_at", within: str = "1 hour") -> DataFrame:
    """First delivery of each content within the watermark; state of older contents expires."""
    return stream.withColumn("hash", T.content_hash(F.col("content"))).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, within).dropDuplicatesWithinWatermark(["hash"])


def session_counts(stream: DataFrame, key: str, ts: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions by gap; a gap of exactly ``gap`` closes a session here, unlike in ``gap_sessions``."""
    s = stream.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", delay)
    return s.groupBy(key, F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def call_rates(stream: DataFrame, fn: str, ts: str, delay: str = "10 minutes") -> DataFrame:
    """Calls per function in sliding windows of five minutes, every minute."""
    s = stream.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", delay)
    return s.groupBy(fn, F.window("at", "5 minutes", "1 minute").alias("w")).agg(F.count("*").alias("n")).select(fn, F.col("w.start").alias("start"), "n")
