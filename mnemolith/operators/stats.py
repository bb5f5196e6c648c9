"""Counts and time series over records, events and usage rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemolith.functions import jsonx
from mnemolith.operators.ingest import CONSUMERS


def dimension_counts(records: DataFrame, dims: dict[str, Column]) -> DataFrame:
    """``dim, value, n`` of several dimensions in one scan; null and blank values are left out."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), c.cast("string").alias("value")) for d, c in dims.items()])).alias("x")
    return records.select(pairs).select("x.dim", "x.value").where("value IS NOT NULL AND value <> ''").groupBy("dim", "value").agg(F.count("*").alias("n"))


def tag_counts(records: DataFrame, k: int = 25) -> DataFrame:
    """The ``k`` most frequent tags."""
    return records.select(F.explode("tags").alias("tag")).where("tag <> ''").groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(k)


def consumer_matrix(records: DataFrame) -> DataFrame:
    """Per phase and consumer: consumed, total, pct (one decimal, as text), backlog; one pass."""
    mask = F.coalesce("consumed_mask", F.lit(0))
    per = records.groupBy("phase").agg(F.count("*").alias("total"), *[F.count_if(mask.bitwiseAND(F.lit(b)) != 0).alias(n) for n, b in CONSUMERS.items()])
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("consumer"), F.col(f"`{n}`").alias("consumed")) for n in CONSUMERS])).alias("x")
    out = per.select("phase", "total", cells).select("phase", "x.consumer", "x.consumed", "total")
    return out.withColumns({"pct": F.format_string("%.1f", F.round(F.col("consumed") * 100 / F.col("total"), 1)), "backlog": F.col("total") - F.col("consumed")})


def daily(records: DataFrame, ts: str) -> DataFrame:
    """Per day: total, inbox, organized; days without rows don't appear, null times are left out."""
    return records.where(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("total"), F.count_if(F.col("phase") == "inbox").alias("inbox"), F.count_if(F.col("phase") == "organized").alias("organized"))


def by_day_and(df: DataFrame, ts: str, key: str) -> DataFrame:
    return df.where(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("day"), F.col(key).alias(key)).agg(F.count("*").alias("n"))


def heatmap(df: DataFrame, ts: str) -> DataFrame:
    """Per day: count and level 0-4 by its ratio to the largest day (over .75, .5, .25)."""
    days = df.where(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))
    ratio = F.col("n") / F.max("n").over(W.partitionBy())  # a row per day, not per record
    return days.withColumn("level", F.when(ratio > 0.75, 4).when(ratio > 0.5, 3).when(ratio > 0.25, 2).when(F.col("n") > 0, 1).otherwise(0))


def clock(df: DataFrame, ts: str) -> DataFrame:
    """Rows by weekday (0 = Sunday) and hour."""
    return df.where(F.col(ts).isNotNull()).groupBy((F.dayofweek(ts) - 1).alias("weekday"), F.hour(ts).alias("hour")).agg(F.count("*").alias("n"))


def streaks(df: DataFrame, key: str, ts: str) -> DataFrame:
    """Per key: active days and longest run of consecutive days."""
    days = df.where(F.col(ts).isNotNull()).select(key, F.to_date(ts).alias("day")).distinct()
    island = F.date_sub("day", F.row_number().over(W.partitionBy(key).orderBy("day")))
    runs = days.withColumn("island", island).groupBy(key, "island").agg(F.count("*").alias("len"))
    return runs.groupBy(key).agg(F.sum("len").alias("active_days"), F.max("len").alias("longest_streak"))


def log_stats(raw: DataFrame) -> DataFrame:
    """Event log in one row: rows, distinct contents, repeats, first, last, and how many rows have each provenance field."""
    has = lambda c: F.count_if(F.coalesce(F.col(c), F.lit("")) != "")
    return raw.agg(F.count("*").alias("rows"), F.count_distinct("content_hash").alias("contents"), F.min("ingested_at").alias("first"), F.max("ingested_at").alias("last"), *[has(c).alias(f"with_{c}") for c in ("session_id", "project", "message_uuid", "role", "model", "prompt_id")])


def verdict_evidence(records: DataFrame) -> DataFrame:
    """Per domain of the metadata: accepted, rejected, pending and other verdicts; accept_rate over decided ones."""
    m = F.col("metadata")
    domain = F.coalesce(F.lower(jsonx.field(m, "domain")), F.lit("general"))
    status = F.lower(jsonx.field(m, "status"))
    rows = records.where(status.isNotNull()).select(domain.alias("domain"), status.alias("status"))
    n = lambda s: F.count_if(F.col("status") == s)
    out = rows.groupBy("domain").agg(n("accepted").alias("accepted"), n("rejected").alias("rejected"), n("pending").alias("pending"), F.count("*").alias("total"))
    other = F.col("total") - F.col("accepted") - F.col("rejected") - F.col("pending")
    decided = F.col("accepted") + F.col("rejected") + other
    return out.withColumns({"ignored": other, "accept_rate": F.round(F.when(decided > 0, F.col("accepted") / decided), 6), "profile_rate": F.round(F.col("accepted") / F.col("total"), 6)})


def consolidation_candidates(records: DataFrame, bit: int, least: int = 5, most_ratio: float = 0.8, k: int = 2) -> DataFrame:
    """Projects worth consolidating: enough organized records, most of them not consumed; the two largest. No project: skipped."""
    r = records.where((F.col("phase") == "organized") & (F.coalesce("project", F.lit("")) != ""))
    out = r.groupBy("project").agg(F.count("*").alias("n"), F.avg((F.coalesce("consumed_mask", F.lit(0)).bitwiseAND(F.lit(bit)) != 0).cast("int")).alias("ratio"))
    return out.where((F.col("n") >= least) & (F.col("ratio") <= most_ratio)).orderBy(F.desc("n"), "project").limit(k).select("project", "n", F.round("ratio", 6).alias("ratio"))
