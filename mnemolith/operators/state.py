"""Project states, reminders, graduation queue, session views: append-only histories folded to their latest values."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolith.functions import text as T


def latest(history: DataFrame, key: str, seq: str) -> DataFrame:
    """Last write of each key wins as a whole; rows with a blank key are refused."""
    cols = [c for c in history.columns if c != key]
    rows = history.withColumn(key, T.trim_space(F.col(key))).where(F.col(key) != "")
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), seq).alias("v")).select(key, "v.*")


def without_blanks(items: Column) -> Column:
    return F.filter(items, lambda x: x.isNotNull() & (T.trim_space(x) != ""))


def age(df: DataFrame, ts: str, as_of: datetime) -> DataFrame:
    """Adds ``age_hours`` and ``stale`` (over 24 hours)."""
    hours = F.timestamp_diff("SECOND", F.col(ts), F.lit(as_of)) / 3600.0
    return df.withColumns({"age_hours": F.round(hours, 4), "stale": hours > 24})


def coverage_gaps(sessions: DataFrame, states: DataFrame, aliases: DataFrame, as_of: datetime, days: int = 14) -> DataFrame:
    """Projects whose newest session is later than their state: ``project, last_state, last_work, delta_hours, task``.

    ``sessions(entity, task, last_seen)``; ``aliases(project, alias)`` is a list kept by hand, broadcast up to
    10,000 rows; ``states(project, updated_at)``. A project without a state has a null ``last_state``.
    """
    recent = sessions.where(F.col("last_seen") >= F.lit(as_of) - F.expr(f"INTERVAL {days} DAYS"))
    rows = aliases.select("project", F.lower("alias").alias("alias")).where("alias <> ''")
    if rows.limit(10_001).count() <= 10_000:  # a longer list is joined without the hint
        rows = F.broadcast(rows)
    hit = recent.join(rows, F.contains(F.lower(F.concat_ws(" ", "entity", "task")), F.col("alias")))
    work = hit.groupBy("project").agg(F.max("last_seen").alias("last_work"), F.max_by("task", F.struct("last_seen", "task")).alias("task"))
    out = work.join(states.select("project", F.col("updated_at").alias("last_state")), "project", "left").where("last_state IS NULL OR last_work > last_state")
    return out.withColumn("delta_hours", F.round(F.timestamp_diff("SECOND", F.col("last_state"), F.col("last_work")) / 3600.0, 4))


def due(reminders: DataFrame, as_of: datetime) -> DataFrame:
    """Pending reminders whose time has come, oldest first."""
    return reminders.where((F.col("status") == "pending") & (F.col("trigger_at") <= F.lit(as_of))).orderBy("trigger_at", "id")


def graduation_queue(rows: DataFrame, k: int = 100) -> DataFrame:
    """Open entries first, newest first; facts that are blank or over 2000 bytes are refused."""
    ok = rows.where((T.trim_space(F.col("fact")) != "") & (F.octet_length("fact") <= 2000))
    return ok.orderBy(F.col("archived_at").isNull().desc(), F.desc("id")).limit(k)


def session_views(records: DataFrame) -> DataFrame:
    """Deterministic part of a session's digest: first and last seen, records, roles, projects."""
    r = records.where(F.coalesce("session_id", F.lit("")) != "")
    return r.groupBy("session_id").agg(F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"), F.count("*").alias("records"), F.count_distinct("project").alias("projects"), F.max("project").alias("project"))


def complete_graduation(rows: DataFrame, entry: int, pointer: str, at: datetime) -> DataFrame:
    """Archive an open entry with a pointer to where the fact went; a blank pointer or an entry that isn't open is an error."""
    if not pointer.strip():
        raise ValueError("a pointer is needed")
    if rows.where((F.col("id") == entry) & F.col("archived_at").isNull()).isEmpty():
        raise ValueError(f"no open entry {entry}")
    hit = F.col("id") == entry
    return rows.withColumns({"archived_at": F.when(hit, F.lit(at)).otherwise(F.col("archived_at")), "pointer": F.when(hit, F.lit(pointer)).otherwise(F.col("pointer"))})
