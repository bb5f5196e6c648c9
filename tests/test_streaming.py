from datetime import datetime, timedelta

from pyspark.sql import functions as F

from mnemolith.operators import ingest, sessions
from mnemolith.streaming import delivery, pipeline

T0 = datetime(2026, 1, 1)
SCHEMA = "seq long, message_uuid string, ingested_at timestamp, content string"


def write(spark, path, rows, n=1):
    spark.createDataFrame(rows, SCHEMA).repartition(n, "seq").write.mode("append").parquet(path)


def test_removed_deliveries(spark, tmp_path):
    rows = [(1, "A", T0, "x"), (2, " a\t", T0 - timedelta(days=400), "x"), (3, "a", None, "y"), (4, "", T0, ""), (5, None, T0, ""), (6, "b", None, "z"), (7, "B", None, "z"), (8, "c", T0, "c"), (9, "C", T0, "c")]
    write(spark, f"{tmp_path}/raw", rows)
    assert {r.seq for r in delivery.removed_deliveries(spark, f"{tmp_path}/raw").collect()} == {1, 3, 7, 9}


def test_late_rows_survive_expired_state(spark, tmp_path):
    """Three batches, a short delay, a restart before each: early deliveries come when the state of their time is gone."""
    p = f"{tmp_path}/raw"
    day = timedelta(days=1)
    write(spark, p, [(1, "a", T0 + 100 * day, "x"), (2, "b", T0 + 300 * day, "y"), (3, "d", None, "w")])
    write(spark, p, [(4, "b", T0 + 301 * day, "y"), (5, "e", T0 + 400 * day, "v"), (6, "e", T0 + 400 * day, "v")])
    write(spark, p, [(7, "a", T0, "x"), (8, "b", T0, "y"), (9, "c", T0, "z"), (10, "e", T0 + 399 * day, "v"), (11, "d", None, "w")])
    log = []
    kept = delivery.kept_deliveries(spark, p, spark.read.parquet(p).schema, batches=3, log=log, delay="1 hour", retention="1 day")
    assert {r.key: r.seq for r in kept.collect()} == {"a": 7, "b": 8, "c": 9, "d": 3, "e": 10}
    assert [x["arrival"] for x in log] == [0, 1, 2] and log[0]["watermark"].startswith("1970") and log[2]["watermark"] > log[1]["watermark"]
    assert sum(x["expired"] for x in log) >= 2 and log[2]["refused"] >= 3, log


def test_batches_equal_one_batch(spark, tmp_path):
    import random

    rnd = random.Random(7)
    rows = [(i, rnd.choice(["m%d" % rnd.randrange(150), " M%d" % rnd.randrange(150), "hot", None, ""]), rnd.choice([None, T0 + timedelta(hours=rnd.randrange(9000))]), "x") for i in range(1500)]
    write(spark, f"{tmp_path}/raw", rows, 3)
    best = {}
    for seq, u, at, _ in rows:
        if u and u.strip():
            best[u.strip().lower()] = min(best.get(u.strip().lower(), (True,)), (at is None, at or T0, seq)) if u.strip().lower() in best else (at is None, at or T0, seq)
    schema = spark.read.parquet(f"{tmp_path}/raw").schema
    for n in (1, 5):
        got = {r.key: r.seq for r in delivery.kept_deliveries(spark, f"{tmp_path}/raw", schema, batches=n, delay="10 days", retention="5 days").collect()}
        assert got == {k: v[2] for k, v in best.items()}


def test_empty_log(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/raw")
    assert delivery.removed_deliveries(spark, f"{tmp_path}/raw").count() == 0


def test_consumer_batches_equal_batch(spark, tmp_path):
    p = f"{tmp_path}/raw"
    for i in range(3):
        write(spark, p, [(10 * i + j, "u", T0, f"content number {(i + j) % 4} here") for j in range(4)])
    s = pipeline.log_stream(spark, p, spark.read.parquet(p).schema, max_files=1)
    pipeline.consume(s, lambda b: ingest.event_log(b.select("seq", "content")), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    inc = spark.read.parquet(f"{tmp_path}/out/batch=*").groupBy("hash").agg(F.min("seq").alias("seq"))
    full = ingest.event_log(spark.read.parquet(p).select("seq", "content")).select("hash", "seq")
    assert sorted(map(tuple, inc.collect())) == sorted(map(tuple, full.collect()))


def test_stream_sessions_match_batch_when_closed(spark, tmp_path):
    at = [0, 5, 20, 100, 110, 400, 5000]
    rows = [(i, "u1", T0 + timedelta(minutes=m), "c") for i, m in enumerate(at)]
    p = f"{tmp_path}/raw"
    write(spark, p, rows)
    s = pipeline.session_counts(spark.readStream.schema(spark.read.parquet(p).schema).parquet(p), "message_uuid", "ingested_at")
    s.writeStream.format("memory").queryName("sess").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = sorted(r.n for r in spark.table("sess").collect())
    batch = sessions.gap_sessions(spark.read.parquet(p), "message_uuid", "ingested_at", "seq").groupBy("session_no").count().collect()
    assert got == [1, 2, 3] and sorted(r["count"] for r in batch) == [1, 1, 2, 3]  # the last session is still open
    assert spark.readStream.schema(spark.read.parquet(p).schema).parquet(p).transform(lambda d: pipeline.call_rates(d, "message_uuid", "ingested_at")).isStreaming
    assert pipeline.first_contents(spark.readStream.schema(spark.read.parquet(p).schema).parquet(p)).isStreaming
