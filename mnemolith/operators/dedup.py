"""Exactly one copy of each at-least-once delivered message (batch form).

The streaming form with a keyed state store is in ``mnemolith.streaming.delivery``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolith.util import key_of


def arrival_order(ts: str = "ingested_at", seq: str = "seq") -> Column:
    """Sortable struct: earliest time first, null time last, then the smallest sequence number."""
    return F.struct(F.col(ts).isNull().alias("late"), F.col(ts).alias("at"), F.col(seq).alias("seq"))


def winners(rows: DataFrame, key: str = "message_uuid", ts: str = "ingested_at", seq: str = "seq", carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per message: ``key`` (normalised), ``seq`` of the kept row and the ``carry`` columns of that row.

    A hash aggregate with map-side combining: a message that holds a third of all rows reaches its reducer as
    one partial row per task. Blank and null ids are no messages and have no row; an empty table gives no row.
    """
    carry = carry or {}
    value = F.struct(F.col(seq).alias("seq"), *[c.alias(n) for n, c in carry.items()])
    keyed = rows.select(key_of(F.col(key)).alias("key"), arrival_order(ts, seq).alias("o"), value.alias("v")).where("key IS NOT NULL")
    best = keyed.groupBy("key").agg(F.min_by("v", "o").alias("v"))
    return best.select("key", "v.*")
