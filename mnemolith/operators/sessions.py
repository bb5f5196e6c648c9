"""Sessions: gap sessionisation, prompt-contiguous order, budgeted chunks, newest rows, prompt inheritance."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def gap_sessions(df: DataFrame, key: str, ts: str, order: str, minutes: int = 30) -> DataFrame:
    """Adds ``session_no`` per key: a gap strictly longer than ``minutes`` starts a new session. Null times are left out."""
    w = W.partitionBy(key).orderBy(ts, order)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    new = F.coalesce((micros - F.lag(micros).over(w) > minutes * 60_000_000).cast("int"), F.lit(1))
    return df.where(F.col(ts).isNotNull()).withColumn("_new", new).withColumn("session_no", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def prompt_order(df: DataFrame, session: str = "session_id", prompt: str = "prompt_id", ts: str = "created_at", key: str = "id") -> DataFrame:
    """Adds ``place``: within a session rows of one prompt stand together, prompts by their first row."""
    blank = F.coalesce(F.col(prompt), F.lit("")) == ""
    first = F.min(F.struct(ts, key)).over(W.partitionBy(session, F.when(blank, F.col(key)).otherwise(F.col(prompt))))
    return df.withColumn("_first", first).withColumn("place", F.row_number().over(W.partitionBy(session).orderBy("_first", ts, key))).drop("_first")


def newest_per(df: DataFrame, key: str, ts: str, tie: str, n: int) -> DataFrame:
    """The newest ``n`` rows of each key."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(F.col(ts).desc_nulls_last(), tie))).where(F.col("place") <= n)


def chunks(df: DataFrame, session: str, order: str, size: str, max_items: int = 20, max_bytes: int = 30_000) -> DataFrame:
    """Adds ``chunk_no``: greedy chunks in order, at most ``max_items`` rows and ``max_bytes`` bytes; a larger row stands alone.

    A fold that no running sum expresses. It carries three numbers per row, in a Python task per session.
    """
    schema = df.select(session, order, size).schema.add("chunk_no", "integer")

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, ignore_index=True)
        no = items = used = 0
        out = []
        for n in rows[size].tolist():
            if items and (items >= max_items or used + n > max_bytes):
                no, items, used = no + 1, 0, 0
            items, used = items + 1, used + n
            out.append(no)
        rows["chunk_no"] = pd.array(out, "int32")
        return rows

    return df.select(session, order, size).groupBy(session).applyInPandas(fold, schema)


def pending(records: DataFrame, bit: int, limit: int | None = None) -> DataFrame:
    """Sessions with records that a consumer has not seen: ``session_id, project, n, first``, oldest first."""
    out = records.where((F.coalesce("session_id", F.lit("")) != "") & (F.coalesce("consumed_mask", F.lit(0)).bitwiseAND(F.lit(bit)) == 0)).groupBy("session_id").agg(F.max("project").alias("project"), F.count("*").alias("n"), F.min("created_at").alias("first"))
    return out.orderBy("first", "session_id").limit(limit) if limit else out


def one_per_message(rows: DataFrame) -> DataFrame:
    """``message_uuid, parent_uuid, prompt_id`` of the first row (by ``seq``) of every message, ids without their dress.

    Case and blanks around an id don't tell messages apart; ids of any length count, blank ones are no message.
    """
    from mnemolith.util import key_of

    keyed = rows.select(key_of(F.col("message_uuid")).alias("message_uuid"), key_of(F.col("parent_uuid")).alias("parent_uuid"), "prompt_id", "seq").where("message_uuid IS NOT NULL")
    return keyed.groupBy("message_uuid").agg(F.min_by(F.struct("parent_uuid", "prompt_id"), "seq").alias("v")).select("message_uuid", "v.*")


def inherited_prompts(rows: DataFrame, most_rounds: int = 40) -> DataFrame:
    """Nearest prompt id up the parent chain: ``(message_uuid, prompt)`` for ``rows(message_uuid, parent_uuid, prompt_id)``.

    Pointer doubling, one join per round; cycles and unknown parents end without a prompt (null).
    """
    from mnemolith.util import materialise

    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    cur = materialise(rows.select(F.col("message_uuid").alias("u"), blank("parent_uuid").alias("up"), blank("prompt_id").alias("prompt")), "chain")
    for _ in range(most_rounds):
        cur = cur.withColumn("up", F.when(F.col("prompt").isNull(), F.col("up")))
        left = cur.where("prompt IS NULL AND up IS NOT NULL").count()
        if not left:
            break
        nxt = cur.select(F.col("u").alias("up"), F.col("up").alias("up2"), F.col("prompt").alias("p2"))
        new = materialise(cur.join(nxt, "up", "left").select("u", F.when(F.col("p2").isNull(), F.col("up2")).alias("up"), F.coalesce("prompt", "p2").alias("prompt")), "chain")
        if new.where("prompt IS NULL AND up IS NOT NULL").count() == left:
            break  # only cycles are left
        cur = new
    return cur.select(F.col("u").alias("message_uuid"), "prompt")


def chunk_project(chunked: DataFrame, session: str = "session_id", chunk: str = "chunk_no", project: str = "project", order: str = "created_at", tie: str = "id") -> DataFrame:
    """``session, chunk, project``: the project all rows of a chunk share, else the first one of the session ('' if none)."""
    named = F.nullif(F.col(project), F.lit(""))
    first = chunked.groupBy(session).agg(F.min_by(named, F.when(named.isNotNull(), F.struct(order, tie))).alias("_first"))
    per = chunked.groupBy(session, chunk).agg(F.count_distinct(F.coalesce(F.col(project), F.lit(""))).alias("_n"), F.max(named).alias("_own"))
    return per.join(first, session).select(session, chunk, F.coalesce(F.when(F.col("_n") == 1, F.col("_own")), "_first", F.lit("")).alias(project))
