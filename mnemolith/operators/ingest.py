"""The write path: gate, content-addressed event log, provenance, records derived by hash, replay.

Everything is append and fold: the log is never rewritten, records are a view of it, and the same function serves batch
replay and micro-batches, because every rule goes by ``seq`` and not by arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolith.functions import text as T

PHASES = ("inbox", "processed", "organized")
CATEGORIES = ("preferences", "decisions", "lessons", "reminders", "habits", "skills", "feedback", "knowledge", "people", "character", "soul", "projects", "tasks", "goals", "values", "relationships", "inbox")
CONSUMERS = {"fact-processor": 1, "consolidate-llm": 2, "enrich-tags": 4, "process-cmd": 8, "entity-extract": 16, "session-digest": 32}
PROVENANCE = ("session_id", "project", "tmux_session", "message_uuid", "parent_uuid", "role", "git_branch", "model", "prompt_id")
MAX_BYTES = 100 * 1024


def verdict(content: Column, phase: Column) -> Column:
    """Gate: ``ok``, ``empty``, ``too_long`` (over 100 KiB) or ``bad_phase``; null content is empty, null phase bad."""
    body = T.trim_space(content)
    return F.when(body.isNull() | (body == ""), "empty").when(F.octet_length(body) > MAX_BYTES, "too_long").when(~F.coalesce(phase.isin(*PHASES), F.lit(False)), "bad_phase").otherwise("ok")


def gated(rows: DataFrame) -> DataFrame:
    """Rows with ``verdict``; content trimmed, tags normalised, hash recomputed, unknown categories re-derived."""
    body = T.trim_space(F.col("content"))
    cat = T.normal_category(F.col("category"))
    known = F.when(cat.isin(*[c for c in CATEGORIES if c != "inbox"]), cat).otherwise(T.category_by_rules(body))
    return rows.withColumns({"verdict": verdict(F.col("content"), F.col("phase")), "content": body, "content_hash": T.content_hash(F.col("content")), "tags": T.normal_tags(F.col("tags")), "category": known})


def event_log(raw: DataFrame) -> DataFrame:
    """First event of each content: the row with the smallest ``seq`` per recomputed hash; blank contents are no events."""
    rows = raw.withColumn("hash", T.content_hash(F.col("content"))).where(F.coalesce(T.trim_space(F.col("content")) != "", F.lit(False)))
    cols = [c for c in raw.columns if c not in ("seq", "hash")]
    return rows.groupBy("hash").agg(F.min("seq").alias("seq"), *[F.min_by(c, "seq").alias(c) for c in cols], F.count("*").alias("deliveries"))


def provenance(raw: DataFrame, columns: tuple[str, ...] = PROVENANCE) -> DataFrame:
    """Per hash and column the first non-empty value by ``seq``: fill-if-empty, whatever the batches were.

    ``min_by`` skips nothing, so empty values are given a null order and lose; a column that is always empty is ''.
    """
    rows = raw.where(F.coalesce(T.trim_space(F.col("content")) != "", F.lit(False))).withColumn("hash", T.content_hash(F.col("content")))
    return rows.groupBy("hash").agg(*[F.coalesce(F.min_by(c, F.when(F.col(c) != "", F.col("seq"))), F.lit("")).alias(c) for c in columns])


def is_pending(mask: Column, consumer: str) -> Column:
    """Whether a consumer has not seen the record; an unknown consumer has seen everything."""
    bit = CONSUMERS.get(consumer)
    return F.lit(False) if bit is None else F.coalesce(mask, F.lit(0)).bitwiseAND(F.lit(bit)) == 0


def apply_marks(records: DataFrame, marks: DataFrame) -> DataFrame:
    """``records`` with ``consumed_mask`` OR-ed with the marks ``(id, consumer)``; unknown consumers are ignored."""
    bit = F.lit(0)
    for name, b in CONSUMERS.items():
        bit = F.when(F.col("consumer") == name, F.lit(b)).otherwise(bit)
    folded = marks.groupBy("id").agg(F.bit_or(bit.cast("long")).alias("new"))
    return records.join(folded, "id", "left").withColumn("consumed_mask", F.coalesce("consumed_mask", F.lit(0)).bitwiseOR(F.coalesce("new", F.lit(0)))).drop("new")


def replay(raw: DataFrame) -> DataFrame:
    """Records from the log: one inbox record per content that is no noise, mask 0, created when first ingested."""
    keep = raw.where(~T.is_noise_event(F.col("content")))
    log = event_log(keep).select("hash", "seq", "content", "source", F.col("ingested_at").alias("created_at"))
    body = T.trim_space(F.col("content"))
    full = log.join(provenance(keep), "hash").withColumn("content", body).where(F.octet_length("content") <= MAX_BYTES)
    return full.withColumns({"phase": F.lit("inbox"), "category": T.category_by_rules(F.col("content")), "tags": T.keywords(F.col("content")), "consumed_mask": F.lit(0).cast("long")})


def upsert(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Records keyed by hash after writing ``incoming``: existing rows keep phase and mask, get missing provenance and
    the merged tags; new rows come in as they are. Both sides have the same columns and one row per hash."""
    cols = [c for c in current.columns if c not in ("hash", "tags")]
    c, i = current.alias("c"), incoming.alias("i")
    out = [F.coalesce(F.nullif(F.col(f"c.{x}"), F.lit("")), F.col(f"i.{x}")).alias(x) if dict(current.dtypes)[x] == "string" else F.coalesce(f"c.{x}", f"i.{x}").alias(x) for x in cols]
    return c.join(i, F.col("c.hash") == F.col("i.hash"), "full").select(F.coalesce("c.hash", "i.hash").alias("hash"), *out, T.normal_tags(F.concat(F.coalesce("c.tags", F.array().cast("array<string>")), F.coalesce("i.tags", F.array().cast("array<string>")))).alias("tags"))


def delete(records: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Records without those whose id is in ``tombstones``; the log keeps their content."""
    return records.join(tombstones.select("id").distinct(), "id", "left_anti")


def numbered(df: DataFrame, by: str, name: str = "n") -> DataFrame:
    """Rows with their rank by a unique column, from 1, without sorting everything in one task.

    Rows are range-partitioned; each partition numbers its own and adds the counts of the partitions before it.
    """
    from pyspark.sql import Window

    from mnemolith.util import materialise

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(df.repartitionByRange(parts, by).withColumn("_p", F.spark_partition_id()), "ranged")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_p").count().select("_p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_o"))  # a row per partition
    local = F.row_number().over(Window.partitionBy("_p").orderBy(by))
    return ranged.withColumn("_n", local).join(F.broadcast(offsets), "_p").withColumn(name, F.col("_n") + F.col("_o")).drop("_p", "_n", "_o")


def by_prefix(records: DataFrame, prefix: str) -> DataFrame:
    """The record with this id, else the only one whose id starts with it; several are an error, none is empty."""
    exact = records.where(F.col("id") == prefix)
    if not exact.isEmpty():
        return exact
    hits = records.where(F.col("id").startswith(prefix))
    n = len(hits.select("id").distinct().limit(2).collect())
    if n > 1:
        raise ValueError(f"ambiguous id {prefix!r}")
    return hits


def with_reads(records: DataFrame, reads: DataFrame) -> DataFrame:
    """Records with the read events ``(id, at)`` folded into ``access_count`` and ``updated_at``."""
    r = reads.groupBy("id").agg(F.count("*").alias("_n"), F.max("at").alias("_at"))
    out = records.join(r, "id", "left")
    return out.withColumns({"access_count": (F.coalesce("access_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).cast("int"), "updated_at": F.greatest("updated_at", "_at")}).drop("_n", "_at")
