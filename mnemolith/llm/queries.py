"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolith.llm import conversations, cooccur, copies, entities, neardup, packing, pii, subjects, tokens
from mnemolith.operators.components import components
from mnemolith.util import materialise, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return cooccur.co_occurrence(table(spark, d, "entity_mentions")).select(F.col("item_a").alias("entity_a"), F.col("item_b").alias("entity_b"))


def p1_lift(spark: SparkSession, d: str) -> DataFrame:
    c = cooccur.co_occurrence(table(spark, d, "entity_mentions"))
    return c.select(F.col("item_a").alias("entity_a"), F.col("item_b").alias("entity_b"), "c", "a", "b", F.round("lift", 6).alias("lift"), F.round("pmi", 6).alias("pmi"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, d, "memories"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every memory with the class of edited versions it belongs to and its number of links."""
    m = table(spark, d, "memories")
    pairs = materialise(neardup.near_duplicates(m), "pairs")
    links = pairs.select(F.explode(F.array("memory_a", "memory_b")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    comp = components(pairs.select(F.col("memory_a").alias("u"), F.col("memory_b").alias("v"))).select(F.col("node").alias("id"), F.col("root").alias("class_id"))
    return m.select("id").join(links, "id", "left").join(comp, "id", "left").select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    return pii.records(table(spark, d, "memories"), table(spark, d, "raw_entries"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d)
    return pii.found(r, pii.learn(r.select("content"), table(spark, d, "entities")))


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d)
    return pii.redacted(r, pii.learn(r.select("content"), table(spark, d, "entities")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.conversations(table(spark, d, "raw_entries")).select("root_uuid", "turn_no", "message_uuid")


def p4_turns(spark: SparkSession, d: str) -> DataFrame:
    """The kept conversations with roles and contents."""
    raw = table(spark, d, "raw_entries")
    kept = conversations.conversations(raw).select("root_uuid", "turn_no", "message_uuid", "role", "seq")
    return kept.join(raw.select("seq", "content"), "seq").select("root_uuid", "turn_no", "role", "content")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.copy_pairs(table(spark, d, "memories"))


def p5_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return copies.collapse(table(spark, d, "memories")).select("id", "copies")


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    """The sets of p5_found with their number of copies; p5_collapsed, as its SQL, leaves the order of fields out."""
    return copies.collapse_dress(table(spark, d, "memories"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return entities.same_entities(table(spark, d, "entities"), table(spark, d, "entity_mentions"))


def p7_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every entity with the class of rows that stand for the same; copies are not expanded into pairs."""
    return entities.entity_classes(table(spark, d, "entities"), table(spark, d, "entity_mentions"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_texts(table(spark, d, "documents"))


def _capacities(spark: SparkSession, d: str) -> dict[str, int]:
    return {r.pack_kind: r.capacity_tokens for r in table(spark, d, "pack_sizes").collect()}  # a table of three rows


def p9_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(tokens.count_tokens(table(spark, d, "documents")), _capacities(spark, d))


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p9_pack(spark, d), _capacities(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subject_areas(*(table(spark, d, t) for t in ("documents", "doc_labels", "subject_areas")))


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    """Number of documents by subject over the whole corpus."""
    s = subjects.subject_areas(*(table(spark, d, t) for t in ("documents", "doc_labels", "subject_areas")), only_unlabelled=False)
    return s.groupBy("subject").agg(F.count("*").alias("documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_lift, p2_found, p2_groups, p3_found, p3_redacted, p4_found, p4_turns, p5_found, p5_collapsed, p5_records, p7_found, p7_classes, p8_ids, p9_pack, p9_fill, p10_found, p10_shares)}

_PAIRS = """
WITH m AS (SELECT DISTINCT entity_id e, memory_id m FROM entity_mentions WHERE entity_id IS NOT NULL AND memory_id IS NOT NULL),
n AS (SELECT count(DISTINCT m) n FROM m), s AS (SELECT e, count(*) k FROM m GROUP BY e),
p AS (SELECT x.e ea, y.e eb, count(*) c FROM m x JOIN m y ON x.m = y.m AND x.e < y.e GROUP BY 1, 2 HAVING count(*) >= 5),
r AS (SELECT ea, eb, c, sa.k a, sb.k b, n.n n FROM p JOIN s sa ON sa.e = ea JOIN s sb ON sb.e = eb, n WHERE c * n.n >= 4 * sa.k * sb.k)
"""
_KEY = r"nullif(lower(regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')), '')"
_CONVERSATIONS = rf"""
WITH RECURSIVE r AS (
  SELECT {_KEY.format("message_uuid")} k, {_KEY.format("parent_uuid")} p, coalesce(session_id, '') ses, seq,
    CASE lower(regexp_replace(coalesce(role, ''), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')) WHEN 'user' THEN 'user' WHEN 'human' THEN 'user'
      WHEN 'assistant' THEN 'assistant' WHEN 'ai' THEN 'assistant' WHEN 'model' THEN 'assistant' WHEN 'system' THEN 'system' ELSE 'unknown' END AS role,
    coalesce(regexp_matches(content, '[^\s\p{{Z}}]'), false) has,
    row_number() OVER (PARTITION BY {_KEY.format("message_uuid")} ORDER BY ingested_at NULLS LAST, seq) rn FROM raw_entries),
m AS (SELECT * FROM r WHERE rn = 1 AND k IS NOT NULL),
walk AS (SELECT k root, 0 t, k, role, ses, has FROM m WHERE p IS NULL
  UNION ALL SELECT w.root, w.t + 1, m.k, m.role, m.ses, m.has FROM walk w JOIN m ON m.p = w.k),
nxt AS (SELECT w.*, (SELECT count(*) FROM m WHERE m.p = w.k) kids, lead(role) OVER c nr, lead(has) OVER c nh FROM walk w WINDOW c AS (PARTITION BY root ORDER BY t)),
good AS (SELECT root FROM nxt GROUP BY root HAVING max(kids) <= 1 AND count(*) FILTER (role = 'unknown') = 0 AND count(DISTINCT ses) = 1
  AND count(*) FILTER (role = 'user' AND has) > 0 AND count(*) FILTER (role = 'user' AND NOT coalesce(nr = 'assistant' AND nh, false)) = 0)
"""

SQL = {
    "p1_found": _PAIRS + "SELECT ea AS entity_a, eb AS entity_b FROM r",
    "p1_lift": _PAIRS + "SELECT ea AS entity_a, eb AS entity_b, c, a, b, round(c::DOUBLE * n / (a::DOUBLE * b), 6) AS lift, round(log2(c::DOUBLE * n / (a::DOUBLE * b)), 6) AS pmi FROM r",
    "p4_found": _CONVERSATIONS + "SELECT root AS root_uuid, t::BIGINT AS turn_no, k AS message_uuid FROM walk JOIN good USING (root)",
    "p4_turns": _CONVERSATIONS + "SELECT w.root AS root_uuid, w.t::BIGINT AS turn_no, w.role, raw_entries.content FROM walk w JOIN good USING (root) JOIN m ON m.k = w.k JOIN raw_entries ON raw_entries.seq = m.seq",
    "p5_collapsed": r"SELECT min(id) AS id, count(*) AS copies FROM memories WHERE content IS NOT NULL GROUP BY regexp_replace(lower(content), '[^\p{L}\p{N}]+', '', 'g')",
}
