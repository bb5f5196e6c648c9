"""Search over records: substring, IDF, BM25, rank fusion, two-pass expansion, recency-weighted smart search, recall.

Records have ``id, content, created_at`` and, where used, ``tags, scope, source, access_count``. Statistics of the
keywords come from one aggregate pass; scores are one projection, and only the best rows are sorted (top-k).
"""

from __future__ import annotations

import math
import re
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemolith.functions import text as T
from mnemolith.functions.text import GRAPH_STOP


def split_query(query: str | None) -> list[str]:
    """Lower-case keywords: separated by ' or ', '|', blanks, tabs and commas, not by line breaks; empty ones dropped."""
    return [k for k in re.split(r"[| \t,，]", (query or "").lower().replace(" or ", "|")) if k]


def trigram_match(query: str | None) -> str:
    """Phrases joined by OR for a trigram index, or '' if a keyword is shorter than three characters."""
    words = split_query(query)
    if not words or any(len(w) < 3 for w in words):
        return ""
    return " OR ".join('"' + w.replace('"', '""') + '"' for w in words)


def question_keywords(question: str | None) -> list[str]:
    """Keywords of a question without a model: ASCII words of two characters, Han runs of 2-3, sliding trigrams of longer runs (at most 8)."""
    out: list[str] = []
    for m in re.findall(r"[A-Za-z0-9.-]{2,}|[㐀-鿿]+", question or ""):
        if m.isascii() or 2 <= len(m) <= 3:
            out.append(m)
        elif len(m) > 3:
            out += [m[i : i + 3] for i in range(min(8, len(m) - 2))]
    return list(dict.fromkeys(out))


def _contains(c: Column, word: str) -> Column:
    return F.coalesce(F.contains(F.lower(c), F.lit(word)), F.lit(False))


def any_keyword(records: DataFrame, query: str, columns: tuple[str, ...] = ("content", "scope", "source"), tags: bool = True) -> DataFrame:
    """Records with any keyword as a substring of one of the columns or of the tags; wildcards are literal."""
    cond = F.lit(False)
    joined = F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " ") if tags else F.lit("")
    for k in split_query(query):
        for c in columns:
            cond = cond | _contains(F.col(c), k)
        cond = cond | _contains(joined, k)
    return records.where(cond)


def newest(df: DataFrame, k: int) -> DataFrame:
    return df.orderBy(F.col("created_at").desc_nulls_last(), "id").limit(k)


def keyword_weights(records: DataFrame, words: list[str], prefixes: bool = True) -> tuple[int, dict[str, float], dict[str, tuple[str, float]]]:
    """Number of records, IDF of each keyword, and for Han keywords the longest shorter prefix that occurs, with its IDF."""
    heads = {w: [w[:n] for n in range(len(w) - 1, 1, -1)] for w in words if prefixes and re.search("[㐀-鿿]", w)}
    every = list(dict.fromkeys([*words, *(p for ps in heads.values() for p in ps)]))
    row = records.agg(F.count("*").alias("n"), *[F.count_if(_contains(F.col("content"), w)).alias(f"k{i}") for i, w in enumerate(every)]).head()
    n, df = row[0], dict(zip(every, row[1:]))
    idf = lambda w: max(0.1, math.log(n / df[w])) if df[w] else 0.0
    return n, {w: idf(w) for w in words}, {w: next(((p, idf(p)) for p in ps if df[p]), ("", 0.0)) for w, ps in heads.items()}


def idf_search(records: DataFrame, query: str, k: int | None = 20) -> DataFrame:
    """Records scored by the sum of their keywords' IDF, the first keyword twice; a Han keyword that a record lacks
    counts by its longest occurring prefix. ``score`` > 0 only; ties newest first. Null contents never match."""
    words = split_query(query)
    _, weight, prefix = keyword_weights(records, words) if words else (0, {}, {})
    score = F.lit(0.0)
    for i, w in enumerate(words):
        boost = 2.0 if i == 0 else 1.0
        hit = F.when(_contains(F.col("content"), w), F.lit(weight[w] * boost))
        if prefix.get(w, ("", 0))[0]:
            hit = hit.when(_contains(F.col("content"), prefix[w][0]), F.lit(prefix[w][1] * boost))
        score = score + hit.otherwise(0.0)
    out = records.withColumn("score", score).where("score > 0")
    return out.orderBy(F.desc("score"), F.col("created_at").desc_nulls_last(), "id").limit(k) if k else out


def bm25_search(records: DataFrame, query: str, k: int = 20, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Okapi BM25 with substring occurrences as term frequency and characters as length; ties newest first."""
    words = list(dict.fromkeys(split_query(query)))
    low = F.lower("content")
    s = records.agg(F.count("*"), F.avg(F.length("content")), *[F.count_if(_contains(F.col("content"), w)) for w in words]).head()
    n, mean, df = s[0], s[1] or 1.0, s[2:]
    score = F.lit(0.0)
    for w, d in zip(words, df):
        tf = T.occurrences(low, w)
        score = score + F.lit(math.log(1 + (n - d + 0.5) / (d + 0.5))) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.length("content") / mean))
    return records.withColumn("score", F.coalesce(score, F.lit(0.0))).where("score > 0").orderBy(F.desc("score"), F.col("created_at").desc_nulls_last(), "id").limit(k)


def fuse(lists: list[DataFrame], k: int = 20, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists ``(id, rank)``: sum of 1/(constant+rank)."""
    all_ = lists[0].select("id", "rank")
    for x in lists[1:]:
        all_ = all_.unionByName(x.select("id", "rank"))
    return all_.groupBy("id").agg(F.sum(1.0 / (F.col("rank") + constant)).alias("rrf")).orderBy(F.desc("rrf"), "id").limit(k)


def ranked(top: DataFrame, *order) -> DataFrame:
    """Ranks from 1 of a list that has been cut to its best rows already (one small task)."""
    return top.select("id", F.row_number().over(W.orderBy(*order)).alias("rank"))


def hybrid_search(records: DataFrame, query: str, k: int = 20, depth: int = 100) -> DataFrame:
    """BM25 and IDF lists of ``depth`` rows each, fused."""
    order = (F.desc("score"), F.col("created_at").desc_nulls_last(), "id")
    return fuse([ranked(bm25_search(records, query, depth), *order), ranked(idf_search(records, query, depth), *order)], k)


def frequent_terms(hits: DataFrame, exclude: list[str] = (), most: int = 5) -> DataFrame:
    """Terms in at least max(3, half) of the hits: ``term, df``, most frequent first; digits and stop words dropped."""
    n = hits.count()
    words = hits.select("id", F.explode(T.terms(F.col("content"))).alias("term")).where(~T.is_graph_stop(F.col("term")) & (F.length("term") >= 2) & ~F.col("term").isin(*exclude, ""))
    return words.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= max(3, n // 2)).orderBy(F.desc("df"), "term").limit(most)


def expansion_search(records: DataFrame, query: str, k: int = 20) -> DataFrame:
    """Two passes: the hits' frequent terms are searched too; first-pass hits keep their places, superseded ones sink.

    Columns ``id, pass_no, score``; a record of both passes counts for the first. ``records`` may have ``superseded``.
    """
    first = idf_search(records, query, k).select("id", "content", "created_at", "score")
    words = [r.term for r in frequent_terms(first, split_query(query)).collect()]  # at most five
    out = first.select("id", F.lit(1).alias("pass_no"), "score")
    if words:
        second = idf_search(records, " or ".join(words), k).select("id", F.lit(2).alias("pass_no"), "score")
        out = out.unionByName(second.join(first.select("id"), "id", "left_anti"))
    return out.orderBy("pass_no", F.desc("score"), "id").limit(k)


def smart_search(records: DataFrame, query: str, as_of: datetime, k: int = 10) -> DataFrame:
    """Occurrence tiers per token, times recency and access boosts, rounded to two places; best ``k``."""
    tokens = [t for t in dict.fromkeys(re.findall(r"[㐀-鿿]|[^\W_]+", (query or "").lower())) if t not in GRAPH_STOP]
    low, tags = F.lower("content"), F.transform(F.coalesce("tags", F.array().cast("array<string>")), F.lower)
    base = F.lit(0.0)
    for t in tokens:
        n = T.occurrences(low, t)
        base = base + F.when(n >= 5, 3.0).when(n >= 3, 2.0).when(n == 2, 1.5).when(n == 1, 1.0).otherwise(0.0) + F.when(F.array_contains(tags, t), 1.0).otherwise(0.0)
    hours = F.greatest(F.timestamp_diff("SECOND", F.col("created_at"), F.lit(as_of)) / 3600.0, F.lit(0.0))
    recency = 1 + 1 / (1 + hours / 168.0)
    access = 1 + F.least(F.coalesce("access_count", F.lit(0)) * 0.1, F.lit(1.0))
    return records.withColumn("score", F.round(base * F.coalesce(recency, F.lit(1.0)) * access, 2)).where("score > 0").orderBy(F.desc("score"), F.col("created_at").desc_nulls_last(), "id").limit(k)


def within_budget(top: DataFrame, budget: int, *order) -> DataFrame:
    """Best rows up to the first that exceeds a token budget (bytes/4, at least 1); ``top`` is cut already."""
    tokens = F.greatest(F.lit(1), F.floor(F.octet_length("content") / 4)).cast("long")
    run = F.sum("tokens").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return top.withColumn("tokens", tokens).withColumn("used", run).where(F.col("used") <= budget)


def round_robin(df: DataFrame, day: str, n: int, *order) -> DataFrame:
    """Up to ``n`` rows spread over the days: the first of each day, then the second, and so on."""
    turn = F.row_number().over(W.partitionBy(day).orderBy(*order))
    return df.withColumn("turn", turn).orderBy("turn", day, *order).limit(n)


def phase_quota(df: DataFrame, quota: dict[str, int], *order) -> DataFrame:
    """Best rows of each phase up to its quota; phases without one get nothing."""
    q = F.lit(0)
    for p, n in quota.items():
        q = F.when(F.col("phase") == p, F.lit(n)).otherwise(q)
    return df.withColumn("place", F.row_number().over(W.partitionBy("phase").orderBy(*order))).where(F.col("place") <= q)
