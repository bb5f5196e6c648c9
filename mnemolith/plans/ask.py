"""From a question to a DataFrame: intents, keywords, retrieval, quotas, snippets, and a bounded search loop."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolith.functions import text as T
from mnemolith.functions.timeparse import DateRange, time_intent
from mnemolith.operators import search

# Words that mark questions of counting, listing and relating.
AGGREGATE = "多少 几个 几条 总数 统计 有哪些 哪些 所有 列出 count".split() + ["how many"]
RELATION = "关系 关联 联系 relation between".split(" ", 3)


def asks_aggregate(q: str) -> bool:
    low = q.lower()
    return any(w in low for w in AGGREGATE) or re.search("什么(?:公司|企业|合同|项目|客户|人)", q) is not None


def related_pair(q: str) -> tuple[str, str] | None:
    """The two sides of a question about a relation, or None."""
    if not any(w in q for w in ("关系", "关联", "联系")) and "relation" not in q.lower():
        return None
    m = re.search(r"([\w.\-]+?)\s*(?:和|与|跟|\band\b)\s*([\w.\-]+?)(?:的|之间|有|是|什么|如何|\s|\?|？|$)", q)
    return (m[1], m[2]) if m else None


@dataclass
class Plan:
    """What a question turned into."""

    kind: str  # time, relation, aggregate or entity
    span: DateRange | None = None
    pair: tuple[str, str] | None = None
    keywords: tuple[str, ...] = ()


def plan(question: str, now: datetime) -> Plan:
    """Time first, then relation, aggregate, and keywords."""
    if span := time_intent(question, now):
        return Plan("time", span=span)
    if pair := related_pair(question):
        return Plan("relation", pair=pair)
    words = tuple(search.question_keywords(question))
    return Plan("aggregate" if asks_aggregate(question) else "entity", keywords=words)


def retrieve(records: DataFrame, question: str, now: datetime, k: int = 20) -> DataFrame:
    """Rows for the question: ``id, phase, created_at, snippet`` or, for an aggregate, ``phase, n``."""
    p = plan(question, now)
    if p.kind == "aggregate":
        return records.groupBy("phase").agg(F.count("*").alias("n"))
    if p.kind == "time":
        hits = records.where((F.col("created_at") >= F.lit(p.span.start)) & (F.col("created_at") < F.lit(p.span.end))).orderBy("created_at", "id").limit(k)
        word = ""
    elif p.kind == "relation":
        hits = search.newest(records.where(F.contains(F.lower("content"), F.lit(p.pair[0].lower())) & F.contains(F.lower("content"), F.lit(p.pair[1].lower()))), k)
        word = p.pair[0]
    else:
        hits = search.idf_search(records, " or ".join(p.keywords), 5 * k)
        quota = {"organized": 6, "processed": 4, "inbox": 12}
        hits = search.phase_quota(hits, quota, F.desc("score"), F.col("created_at").desc_nulls_last(), "id")
        word = p.keywords[0] if p.keywords else ""
    return hits.select("id", "phase", "created_at", (T.snippet(F.col("content"), word) if word else T.preview(F.col("content"), 300)).alias("snippet"))


def search_loop(records: DataFrame, question: str, steps: int = 10, enough: int = 5) -> list[str]:
    """Plan, search, observe: widen from all keywords to single ones until enough records are found; their ids in order."""
    words = search.question_keywords(question)
    found: list[str] = []
    for q in [" or ".join(words), *words][:steps]:
        if not q or len(found) >= enough:
            break
        found += [r.id for r in search.idf_search(records, q, enough).select("id").collect() if r.id not in found]
    return found[:enough]
