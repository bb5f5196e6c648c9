"""Streaming de-duplication of messages that were delivered at least once.

A keyed state store holds, per message id and retention bucket of event time, the earliest delivery seen so far.
State older than the watermark is dropped; what it knew stays in a ledger that is written per micro-batch under its
batch id, so replaying a batch after a failure overwrites the same folder: state checkpoint and output advance together.
Deliveries without an event time, or older than the watermark of the batch they came in, are refused by the store and
noted in the ledger by themselves; the late-arrival lookup then compares all ledger entries of an id, also those of
states that had expired in between, and the earliest one wins.

``kept_deliveries`` works through a log in the order it arrived: one batch after another is put into the folder that is
watched, and the query starts again from its checkpoint for each, as it would after any stop.
"""

from __future__ import annotations

import json
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemolith.util import key_of, scratch

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _settings(spark: SparkSession, **conf: str):
    names = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _keyed(rows: DataFrame, key: str, ts: str, seq: str) -> DataFrame:
    return rows.select(key_of(F.col(key)).alias("key"), F.col(ts).cast("timestamp_ntz").alias("at"), F.col(seq).cast("long").alias("seq")).where("key IS NOT NULL")


def _best():
    return F.min(F.struct(F.col("at").isNull().alias("late"), "at", "seq")).alias("best")


def delivery_ledger(stream: DataFrame, path: str, checkpoint: str, *, key: str = "message_uuid", ts: str = "ingested_at", seq: str = "seq", delay: str = "30 days", retention: str = "30 days"):
    """Start the streaming query that maintains the ledger at ``path``; returns the query.

    ``delay`` bounds how late a delivery may be and still meet its state; ``retention`` is the width of the event-time
    buckets in which state lives and expires. Both limit the state, never the result: ``late_deliveries`` and
    ``settle`` treat whatever had expired. Rows with a blank or null id are no messages; a null ``ts`` has no place in
    event time, so those rows are left to ``late_deliveries``.
    """
    timed = (
        _keyed(stream, key, ts, seq)
        .where("at IS NOT NULL")
        .withColumn("clock", F.col("at").cast("timestamp"))
        .withWatermark("clock", delay)
        .groupBy("key", F.window("clock", retention).alias("bucket"))
        .agg(_best())
        .select("key", "best")
    )

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id:08d}")

    return timed.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()


def late_deliveries(rows: DataFrame, watermark: str | None = None, *, key: str = "message_uuid", ts: str = "ingested_at", seq: str = "seq") -> DataFrame:
    """Ledger entries of rows the state store refused: without a time, or older than ``watermark``, the one of the batch
    they came in. The watermark before any event is 1970, so nothing is older than that."""
    late = F.col("at").isNull()
    if watermark:
        late = late | (F.col("at").cast("timestamp") < F.lit(watermark).cast("timestamp"))
    return _keyed(rows, key, ts, seq).where(late).groupBy("key").agg(_best())


def settle(ledger: DataFrame) -> DataFrame:
    """Late-arrival lookup: of all ledger entries of an id the earliest stays. Columns ``key``, ``seq``."""
    return ledger.groupBy("key").agg(F.min("best").alias("best")).select("key", F.col("best.seq").alias("seq"))


LEDGER = "key string, best struct<late: boolean, at: timestamp_ntz, seq: bigint>"


def arrivals(rows: DataFrame, batches: int, *, key: str = "message_uuid", ts: str = "ingested_at", seq: str = "seq") -> str:
    """Write the narrow columns ``key, at, seq`` to a folder per batch of arrival and return the path above them.

    Batches are ranges of ``seq`` at its approximate quantiles, so nothing is shuffled; equal counts don't matter.
    """
    path = scratch(rows.sparkSession, "arrivals")
    cuts = sorted(set(rows.approxQuantile(seq, [i / batches for i in range(1, batches)], 0.01))) if batches > 1 else []
    no = F.lit(0)
    for c in cuts:
        no = no + F.coalesce((F.col("seq") > c).cast("int"), F.lit(0))
    rows.select(key_of(F.col(key)).alias("key"), F.col(ts).cast("timestamp_ntz").alias("at"), F.col(seq).cast("long").alias("seq")).where("key IS NOT NULL").withColumn("arrival", no).write.partitionBy("arrival").parquet(path)
    return path


NARROW = "key string, at timestamp_ntz, seq bigint"


def deliver(spark: SparkSession, path: str, base: str, batches: int, **options) -> list[dict]:
    """Run the stream over the folders of ``arrivals`` in turn, from its checkpoint each time.

    Returns for each batch ``arrival``, the ``watermark`` it met, and the store's numbers of rows ``refused`` as too
    late, and of states ``expired`` and ``kept``.
    """
    log = []
    for i in range(batches):
        batch = spark.read.schema(NARROW + ", arrival int").parquet(path).where(F.col("arrival") == i).drop("arrival")
        batch.write.mode("overwrite").parquet(f"{base}/inbox/batch={i}")
        stream = spark.readStream.schema(NARROW).parquet(f"{base}/inbox")
        query = delivery_ledger(stream, f"{base}/ledger", f"{base}/state", key="key", ts="at", seq="seq", **options)
        query.awaitTermination()
        seen = [_progress(p) for p in query.recentProgress]
        state = [o for p in seen for o in p.get("stateOperators", [])]
        marks = [p["eventTime"]["watermark"] for p in seen if p.get("eventTime", {}).get("watermark")]
        total = lambda name: sum(o.get(name, 0) for o in state)
        log.append({"arrival": i, "watermark": max(marks, default=None), "refused": total("numRowsDroppedByWatermark"), "expired": total("numRowsRemoved"), "kept": state[-1].get("numRowsTotal", 0) if state else 0})
    return log


def kept_deliveries(spark: SparkSession, source: str, schema: T.StructType, batches: int = 4, log: list | None = None, **options) -> DataFrame:
    """Stream all rows of ``source`` in ``batches`` and return the kept ``(key, seq)``; no files or rows give none.

    ``seq`` must be unique; of equal times the smallest ``seq`` stays, a null time counts as latest. ``log``, if given,
    gets what ``deliver`` returns.
    """
    base = scratch(spark, "delivery")
    columns = {k: options.pop(k) for k in ("key", "ts", "seq") if k in options}
    path = arrivals(spark.read.schema(schema).parquet(source), batches, **columns)
    with _settings(spark, spark__sql__streaming__stateStore__providerClass=ROCKS, spark__sql__streaming__noDataMicroBatches__enabled="false"):
        done = deliver(spark, path, base, batches, **options)
    if log is not None:
        log += done
    landed = spark.read.schema(NARROW + ", arrival int").parquet(path)
    # Each batch's own watermark decides which of its rows the store refused; there are as many as batches.
    mark = F.lit(None).cast("string")
    for x in done:
        mark = F.when(F.col("arrival") == x["arrival"], F.lit(x["watermark"])).otherwise(mark)
    late = landed.where(F.col("at").isNull() | (F.col("at").cast("timestamp") < mark.cast("timestamp")))
    entries = late.groupBy("key").agg(_best())
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there = jvm.org.apache.hadoop.fs.Path(f"{base}/ledger")
    if there.getFileSystem(conf).exists(there):
        entries = spark.read.schema(LEDGER).parquet(f"{base}/ledger/batch=*").unionByName(entries)
    return settle(entries)


def _glob(source: str) -> str:
    """As a glob, a path may be a single file; a plain path of a file stream must be a directory."""
    return source if any(x in source for x in "*?[{") else f"{source[:-1]}[{source[-1]}]"


def _progress(p) -> dict:
    return p if isinstance(p, dict) else json.loads(p.json)


def removed_deliveries(spark: SparkSession, source: str, **options) -> DataFrame:
    """The rows of ``source`` that repeat a message: every row with an id whose ``seq`` was not kept (column ``seq``)."""
    rows = spark.read.parquet(source)
    kept = kept_deliveries(spark, source, rows.schema, **options)
    messages = rows.select("seq", key_of(F.col("message_uuid")).alias("key")).where("key IS NOT NULL").select("seq")
    return messages.join(kept.select("seq"), "seq", "left_anti")
