"""Queries of the core operators over the test tables, and the SQL that states the same results.

The log is ``raw_entries``, the records are ``memories``; ``documents`` serve searches over long texts and ``events``
stand for the usage ledger.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemolith.functions import jsonx
from mnemolith.functions import text as T
from mnemolith.operators import graph, ingest, search, sessions, state, stats, usage, versioning
from mnemolith.streaming.delivery import removed_deliveries
from mnemolith.util import table

AS_OF = datetime(2026, 7, 1)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "memories")


def documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents as records."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "source", "project", "created_at", F.lit(None).cast("array<string>").alias("tags"), F.lit("").alias("scope"), (F.col("doc_id") % 7).cast("int").alias("access_count"))


def calls(spark: SparkSession, d: str) -> DataFrame:
    """Events as rows of the usage ledger."""
    return table(spark, d, "events").select(F.col("event_id").alias("id"), "ts", F.col("event_type").alias("fn"), F.col("user_id").alias("session"), F.col("props").alias("context"), F.col("value").alias("tokens"), (F.col("event_type") == "error").alias("error"))


# SQL fragments
TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
C = TRIM.format("content")
KEYWORD_STOP, TERM_STOP, GRAPH_STOP = (", ".join("'" + w.replace("'", "''") + "'" for w in x) for x in (T.KEYWORD_STOP, T.TERM_STOP, T.GRAPH_STOP))
CUES = " ".join(f"WHEN regexp_matches({{0}}, '(?i)\\b(?:{'|'.join(c.replace(chr(39), chr(39) * 2) for c in cues)})\\b') THEN '{cat}'" for cat, cues in T.CATEGORY_CUES.items())
WORDS = r"list_filter(regexp_extract_all({0}, '[A-Za-z][A-Za-z0-9]+(?:[-./+][A-Za-z0-9]+)*'), lambda x: length(x) >= 3 AND lower(x) NOT IN (" + KEYWORD_STOP + "))"
CATEGORY = "CASE " + CUES + " WHEN len(" + WORDS + ") > 0 THEN 'knowledge' ELSE 'inbox' END"
ASCII_TERMS = r"list_filter(regexp_extract_all(lower({0}), '[a-z0-9][a-z0-9._-]+'), lambda x: x NOT IN (" + TERM_STOP + "))"
HAN_TERMS = r"flatten(list_transform(list_filter(regexp_extract_all({0}, '[\x{{4e00}}-\x{{9fff}}]+'), lambda r: length(r) >= 2), lambda r: list_transform(range(2, least(4, length(r)) + 1), lambda n: r[1:n])))"
TERMS = "list_distinct(list_concat(" + ASCII_TERMS + ", " + HAN_TERMS + "))"
DOCS = "(SELECT doc_id AS id, text AS content, source, project, created_at, (doc_id % 7)::INT AS access_count FROM documents)"


# --- log and write path ---------------------------------------------------------------------------------------------


@query(r"""SELECT seq FROM (SELECT seq, row_number() OVER (PARTITION BY lower(regexp_replace(message_uuid, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) ORDER BY ingested_at NULLS LAST, seq) rn
FROM raw_entries WHERE regexp_replace(message_uuid, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') <> '') WHERE rn > 1""")
def p6_found(spark, d):
    return removed_deliveries(spark, f"{d}/raw_entries.parquet")


@query("SELECT seq, row_number() OVER (ORDER BY seq) AS n, source FROM raw_entries")
def w1_event_numbers(spark, d):
    return ingest.numbered(table(spark, d, "raw_entries").select("seq", "source"), "seq").select("seq", F.col("n").cast("long").alias("n"), "source")


@query(f"""SELECT id, CASE WHEN coalesce({C}, '') = '' THEN 'empty' WHEN strlen({C}) > 102400 THEN 'too_long' WHEN coalesce(phase IN ('inbox','processed','organized'), false) THEN 'ok' ELSE 'bad_phase' END AS verdict,
sha256({C}) AS content_hash, coalesce(len(list_distinct(list_filter(list_transform(tags, lambda t: trim(t)), lambda t: t <> ''))), 0)::VARCHAR AS n_tags FROM memories""")
def d1_gate(spark, d):
    return ingest.gated(records(spark, d)).select("id", "verdict", "content_hash", F.size("tags").cast("string").alias("n_tags"))


@query(f"SELECT min(seq) AS seq, sha256({C}) AS hash, count(*) AS deliveries FROM raw_entries WHERE {C} <> '' GROUP BY 2")
def d2_event_log(spark, d):
    return ingest.event_log(table(spark, d, "raw_entries").select("seq", "content")).select("seq", "hash", "deliveries")


@query(f"""SELECT sha256({C}) AS hash, """ + ", ".join(f"coalesce(arg_min({c}, seq) FILTER ({c} <> ''), '') AS {c}" for c in ingest.PROVENANCE) + f" FROM raw_entries WHERE {C} <> '' GROUP BY 1")
def d3_provenance(spark, d):
    return ingest.provenance(table(spark, d, "raw_entries"))


@query(f"""WITH m AS (SELECT sha256({C}) h, * FROM memories WHERE {C} <> '')
SELECT h AS hash, min_by(id, struct_pack(created_at, id)) AS id, count(*) AS n, array_to_string(list_sort(list_distinct(flatten(list(list_filter(list_transform(coalesce(tags, []), lambda t: trim(t)), lambda t: t <> ''))))), ' ') AS tags FROM m GROUP BY h""")
def d4_records_by_hash(spark, d):
    m = records(spark, d).withColumn("hash", T.content_hash(F.col("content"))).where(T.trim_space(F.col("content")) != "")
    return m.groupBy("hash").agg(F.min_by("id", F.struct("created_at", "id")).alias("id"), F.count("*").alias("n"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(T.normal_tags(F.col("tags")))))), " ").alias("tags"))


@query("SELECT id, array_to_string(list_sort(list_filter(list_distinct(list_concat(coalesce(tags, []), ['review'])), lambda t: t <> 'claude')), ' ') AS tags FROM memories")
def d6_edit_tags(spark, d):
    return records(spark, d).select("id", F.array_join(T.edit_tags(F.col("tags"), ["review"], ["claude"]), " ").alias("tags"))


@query("SELECT m.id, coalesce(m.consumed_mask, 0) | coalesce(x.b, 0) AS mask FROM memories m LEFT JOIN (SELECT memory_id, bit_or(CASE WHEN id % 2 = 0 THEN 16 ELSE 4 END)::BIGINT b FROM entity_mentions GROUP BY 1) x ON x.memory_id = m.id")
def d9_marks(spark, d):
    marks = table(spark, d, "entity_mentions").select(F.col("memory_id").alias("id"), F.when(F.col("id") % 2 == 0, "entity-extract").otherwise("enrich-tags").alias("consumer"))
    return ingest.apply_marks(records(spark, d), marks).select("id", F.col("consumed_mask").alias("mask"))


@query("SELECT m.id FROM memories m WHERE NOT EXISTS (SELECT 1 FROM entity_mentions e WHERE e.memory_id = m.id)")
def d10_delete(spark, d):
    return ingest.delete(records(spark, d), table(spark, d, "entity_mentions").select(F.col("memory_id").alias("id"))).select("id")


@query("SELECT id, 'reviewed' AS status, json_extract_string(metadata, '$.domain') AS domain FROM memories")
def d11_metadata_patch(spark, d):
    m = records(spark, d).withColumn("m", jsonx.merge_patch(F.col("metadata"), F.lit('{"status": "reviewed"}')))
    return m.select("id", F.get_json_object("m", "$.status").alias("status"), F.get_json_object("m", "$.domain").alias("domain"))


@query(f"""SELECT sha256({C}) AS hash, min(seq) AS seq, {CATEGORY.format(f'any_value({C})')} AS category, coalesce(arg_min(project, seq) FILTER (project <> ''), '') AS project FROM raw_entries
WHERE {C} <> '' AND NOT starts_with({C}, '[thinking]') AND NOT regexp_matches({C}, '^(Q: |\\* )?<task-notification') AND strlen({C}) <= 102400 GROUP BY 1""")
def d14_replay(spark, d):
    return ingest.replay(table(spark, d, "raw_entries")).select("hash", "seq", "category", "project")


# --- listings and predicates ----------------------------------------------------------------------------------------


@query("SELECT id, created_at, category FROM memories WHERE phase = 'organized' AND scope = 'global' AND created_at > '2025-01-01' AND list_contains(list_transform(tags, lambda t: lower(t)), 'claude') ORDER BY created_at DESC, id LIMIT 50")
def s1_list(spark, d):
    r = records(spark, d).where((F.col("phase") == "organized") & (F.col("scope") == "global") & (F.col("created_at") > F.lit(datetime(2025, 1, 1))) & T.has_all_tags(F.col("tags"), ["Claude"]))
    return search.newest(r, 50).select("id", "created_at", "category")


@query("SELECT id, length(content) AS n FROM memories WHERE starts_with(id, 'a')")
def s3_prefix(spark, d):
    return records(spark, d).where(F.col("id").startswith("a")).select("id", F.length("content").alias("n"))


@query("SELECT id FROM memories WHERE consumed_mask & 16 = 0 AND phase IN ('organized', 'processed')")
def pred_pending(spark, d):
    return records(spark, d).where(ingest.is_pending(F.col("consumed_mask"), "entity-extract") & F.col("phase").isin("organized", "processed")).select("id")


@query("SELECT id, CASE WHEN length(content) > 72 THEN content[1:72] || '...' ELSE content END AS preview FROM memories")
def preview(spark, d):
    return records(spark, d).select("id", T.preview(F.col("content")).alias("preview"))


# --- text functions -------------------------------------------------------------------------------------------------


@query(f"""WITH w AS (SELECT id, lower(u.w) w, u.i FROM memories, unnest({WORDS.format('content')}) WITH ORDINALITY u(w, i)),
g AS (SELECT id, w, count(*) n, min(i) i FROM w GROUP BY 1, 2),
r AS (SELECT id, w, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN regexp_matches(w, '[-./+]') THEN 0 ELSE 1 END, n DESC, length(w) DESC, i) rn FROM g)
SELECT m.id, coalesce(string_agg(r.w, ' ' ORDER BY rn), '') AS keywords FROM memories m LEFT JOIN r ON r.id = m.id AND rn <= 6 GROUP BY m.id""")
def f1_keywords(spark, d):
    return records(spark, d).select("id", F.array_join(T.keywords(F.col("content")), " ").alias("keywords"))


@query(f"SELECT id, {CATEGORY.format('content')} AS category FROM memories")
def f2_categories(spark, d):
    return records(spark, d).select("id", T.category_by_rules(F.col("content")).alias("category"))


@query(f"SELECT t AS term, count(*) AS df FROM (SELECT unnest({TERMS.format('content')}) t FROM memories) GROUP BY 1")
def f3_terms(spark, d):
    return records(spark, d).select(F.explode(T.terms(F.col("content"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


@query(r"SELECT DISTINCT doc_id AS source, lower(regexp_replace(t, '^\s+|\s+$', '', 'g')) AS target_title FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?s)\[\[(.*?)\]\]', 1)) t FROM documents) WHERE regexp_replace(t, '^\s+|\s+$', '', 'g') <> ''")
def f4_wiki_links(spark, d):
    return graph.link_edges(documents(spark, d))


@query("SELECT id, trim(regexp_replace(translate(lower(content), chr(10), ' '), '\\r', '', 'g')) IS NULL AS blank, md5(substr(trim(regexp_replace(replace(replace(lower(content), chr(10), ' '), chr(13), ''), ' {2,}', ' ', 'g')), 1, 200)) AS fp FROM memories")
def f5_fingerprint(spark, d):
    return records(spark, d).select("id", F.col("content").isNull().alias("blank"), F.md5(T.fingerprint(F.col("content"))).alias("fp"))


@query(r"SELECT doc_id AS id, substr(regexp_replace(split_part(text, chr(10), 1), '^\s+|\s+$', '', 'g'), 1, 100) AS title FROM documents")
def f6_titles(spark, d):
    return documents(spark, d).select("id", T.title(F.col("content")).alias("title"))


@query(r"""SELECT id, CASE WHEN regexp_matches(lower(name), '公司|有限|inc|ltd|corp|gmbh') THEN 'company' WHEN strlen(name) >= 4 AND regexp_matches(name, '[0-9]') THEN 'identifier'
WHEN regexp_matches(lower(name), '\.com|\.cn|\.io|\.de') THEN 'domain' WHEN regexp_matches(lower(name), 'api|sdk|css|html|json|sql|tls|dns|ssh') THEN 'technology' ELSE 'concept' END AS kind FROM entities""")
def f7_entity_kinds(spark, d):
    return table(spark, d, "entities").select("id", T.entity_kind(F.col("name")).alias("kind"))


@query(r"""SELECT seq FROM raw_entries WHERE strlen(content) < 10 OR regexp_matches(lower(regexp_replace(content, '^\s+', '')), '^(/|\$ |> |<bash-input>|<bash-output>)') OR NOT regexp_matches(lower(content), '[a-z0-9一-鿿]')
OR lower(regexp_replace(content, '^\s+|\s+$', '', 'g')) IN ('hello','hi','hey','ok','okay','thanks','thank you','yes','no','yep','nope','sure','cool','nice','继续','好的','谢谢','对','嗯','可以','go ahead','please','continue','skip','next')""")
def s11_noise(spark, d):
    return table(spark, d, "raw_entries").where(T.is_noise(F.col("content"))).select("seq")


# --- search ---------------------------------------------------------------------------------------------------------

IDF = f"""WITH r AS (SELECT * FROM {DOCS}), s AS (SELECT count(*) n, count(*) FILTER (contains(lower(content), 'rollback')) a, count(*) FILTER (contains(lower(content), 'garlic')) b FROM r),
w AS (SELECT CASE WHEN a > 0 THEN greatest(0.1, ln(n / a)) ELSE 0 END wa, CASE WHEN b > 0 THEN greatest(0.1, ln(n / b)) ELSE 0 END wb FROM s),
x AS (SELECT id, created_at, CASE WHEN contains(lower(content), 'rollback') THEN wa * 2 ELSE 0 END + CASE WHEN contains(lower(content), 'garlic') THEN wb ELSE 0 END AS score FROM r, w)
"""


@query(IDF + "SELECT id, round(score, 6) AS score FROM x WHERE score > 0 ORDER BY x.score DESC, created_at DESC NULLS LAST, id LIMIT 20")
def q_idf_search(spark, d):
    return search.idf_search(documents(spark, d), "rollback garlic", 20).select("id", F.round("score", 6).alias("score"))


@query("SELECT id FROM memories WHERE contains(lower(content), 'rollback') OR contains(lower(scope), 'rollback') OR contains(lower(source), 'rollback') OR contains(lower(array_to_string(tags, ' ')), 'rollback') OR contains(lower(content), 'garlic') OR contains(lower(scope), 'garlic') OR contains(lower(source), 'garlic') OR contains(lower(array_to_string(tags, ' ')), 'garlic') ORDER BY created_at DESC NULLS LAST, id LIMIT 100")
def q4_any_keyword(spark, d):
    return search.newest(search.any_keyword(records(spark, d), "rollback or garlic"), 100).select("id")


BM25 = f"""WITH r AS (SELECT * FROM {DOCS}), s AS (SELECT count(*) n, avg(length(content)) m, count(*) FILTER (contains(lower(content), 'rollback')) a, count(*) FILTER (contains(lower(content), 'garlic')) b FROM r),
f AS (SELECT id, created_at, length(content) l, ((length(lower(content)) - length(replace(lower(content), 'rollback', ''))) // 8) ta, ((length(lower(content)) - length(replace(lower(content), 'garlic', ''))) // 6) tb, s.* FROM r, s),
b AS (SELECT id, created_at, coalesce(ln(1 + (n - a + 0.5) / (a + 0.5)) * ta * 2.2 / (ta + 1.2 * (0.25 + 0.75 * l / m)) + ln(1 + (n - b + 0.5) / (b + 0.5)) * tb * 2.2 / (tb + 1.2 * (0.25 + 0.75 * l / m)), 0) AS score FROM f)
"""


@query(BM25 + "SELECT id, round(score, 6) AS score FROM b WHERE score > 0 ORDER BY b.score DESC, created_at DESC NULLS LAST, id LIMIT 20")
def q4_bm25(spark, d):
    return search.bm25_search(documents(spark, d), "rollback garlic", 20).select("id", F.round("score", 6).alias("score"))


@query(IDF + BM25.replace("WITH r AS", ", r2 AS", 1).replace("FROM r,", "FROM r2,").replace("FROM r)", "FROM r2)").replace(" s AS", " s2 AS").replace("r2, s)", "r2, s2 s)") + """,
u AS (SELECT id, row_number() OVER (ORDER BY score DESC, created_at DESC NULLS LAST, id) k FROM (SELECT * FROM b WHERE score > 0 ORDER BY score DESC, created_at DESC NULLS LAST, id LIMIT 100)
UNION ALL SELECT id, row_number() OVER (ORDER BY score DESC, created_at DESC NULLS LAST, id) k FROM (SELECT * FROM x WHERE score > 0 ORDER BY score DESC, created_at DESC NULLS LAST, id LIMIT 100)),
z AS (SELECT id, sum(1.0::DOUBLE / (60 + k)) q FROM u GROUP BY id) SELECT id, round(q, 6) AS rrf FROM z ORDER BY q DESC, id LIMIT 20""")
def q5_hybrid(spark, d):
    return search.hybrid_search(documents(spark, d), "rollback garlic", 20).select("id", F.round("rrf", 6).alias("rrf"))


@query()
def q8_expansion(spark, d):
    return search.expansion_search(documents(spark, d), "rollback", 20).select("id", "pass_no", F.round("score", 6).alias("score"))


TIER = "CASE WHEN {0} >= 5 THEN 3.0 WHEN {0} >= 3 THEN 2.0 WHEN {0} = 2 THEN 1.5 WHEN {0} = 1 THEN 1.0 ELSE 0.0 END"


@query(f"""WITH f AS (SELECT *, (length(lower(content)) - length(replace(lower(content), 'rollback', ''))) // 8 ta, (length(lower(content)) - length(replace(lower(content), 'garlic', ''))) // 6 tb FROM {DOCS}),
s AS (SELECT id, created_at, round((({TIER.format('ta')} + {TIER.format('tb')})::DOUBLE * coalesce(1 + 1 / (1 + greatest(date_diff('microsecond', created_at, TIMESTAMP '2026-07-01') // 1000000 / 3600.0::DOUBLE, 0) / 168.0::DOUBLE), 1) * (1 + least(access_count * 0.1::DOUBLE, 1)))::DOUBLE, 2) AS score FROM f)
SELECT id, score FROM s WHERE score > 0 ORDER BY score DESC, created_at DESC NULLS LAST, id LIMIT 10""")
def q9_smart(spark, d):
    return search.smart_search(documents(spark, d), "rollback garlic", AS_OF, 10).select("id", "score")


@query(IDF + """, t AS (SELECT x.id, x.score, x.created_at, greatest(1, strlen(r.content) // 4) AS tokens FROM x JOIN r ON r.id = x.id WHERE x.score > 0 ORDER BY x.score DESC, x.created_at DESC NULLS LAST, x.id LIMIT 50)
SELECT id, tokens::BIGINT AS tokens FROM (SELECT *, sum(tokens) OVER (ORDER BY score DESC, created_at DESC NULLS LAST, id ROWS UNBOUNDED PRECEDING) u FROM t) WHERE u <= 4000""")
def q10_recall(spark, d):
    top = search.idf_search(documents(spark, d), "rollback garlic", 50)
    return search.within_budget(top, 4000, F.desc("score"), F.col("created_at").desc_nulls_last(), "id").select("id", "tokens")


@query("SELECT id, CASE WHEN p = 0 THEN CASE WHEN length(content) > 300 THEN content[1:300] || '...' ELSE content END ELSE (CASE WHEN greatest(p - 100, 1) > 1 THEN '...' ELSE '' END) || substr(content, greatest(p - 100, 1), 300) || (CASE WHEN length(content) >= greatest(p - 100, 1) + 300 THEN '...' ELSE '' END) END AS snippet FROM (SELECT id, content, strpos(lower(content), 'rollback') p FROM memories WHERE contains(lower(content), 'rollback'))")
def q12_snippets(spark, d):
    return records(spark, d).where(F.contains(F.lower("content"), F.lit("rollback"))).select("id", T.snippet(F.col("content"), "rollback").alias("snippet"))


@query("WITH h AS (SELECT id, created_at::DATE AS day, created_at FROM memories WHERE contains(lower(content), 'rollback') AND created_at IS NOT NULL) SELECT id, day FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY created_at DESC, id) t FROM h) ORDER BY t, day, created_at DESC, id LIMIT 30")
def w10_round_robin(spark, d):
    h = records(spark, d).where(F.contains(F.lower("content"), F.lit("rollback")) & F.col("created_at").isNotNull()).select("id", F.to_date("created_at").alias("day"), "created_at")
    return search.round_robin(h, "day", 30, F.desc("created_at"), "id").select("id", "day")


@query("SELECT id, phase, place::INT AS place FROM (SELECT id, phase, row_number() OVER (PARTITION BY phase ORDER BY created_at DESC NULLS LAST, id) place FROM memories) WHERE place <= CASE phase WHEN 'organized' THEN 6 WHEN 'processed' THEN 4 WHEN 'inbox' THEN 12 ELSE 0 END")
def w11_quota(spark, d):
    return search.phase_quota(records(spark, d), {"organized": 6, "processed": 4, "inbox": 12}, F.col("created_at").desc_nulls_last(), "id").select("id", "phase", "place")


# --- statistics -----------------------------------------------------------------------------------------------------

DIMS = {"phase": "phase", "category": "category", "source": "source", "role": "coalesce(nullif(role, ''), 'unknown')", "model": "model", "session": "session_id", "project": "project"}


@query(" UNION ALL ".join(f"SELECT '{d}' AS dim, {e} AS value, count(*) AS n FROM memories WHERE {e} <> '' GROUP BY 2" for d, e in DIMS.items()))
def a1_counts(spark, d):
    return stats.dimension_counts(records(spark, d), {k: F.expr(e) for k, e in DIMS.items()})


@query("SELECT tag, count(*) AS n FROM (SELECT unnest(tags) tag FROM memories) WHERE tag <> '' GROUP BY 1 ORDER BY n DESC, tag LIMIT 25")
def a1_tags(spark, d):
    return stats.tag_counts(records(spark, d))


@query(" UNION ALL ".join(f"SELECT phase, '{n}' AS consumer, count(*) FILTER (consumed_mask & {b} <> 0) AS consumed, count(*) AS total, printf('%.1f', round(count(*) FILTER (consumed_mask & {b} <> 0) * 100 / count(*), 1)) AS pct, count(*) - count(*) FILTER (consumed_mask & {b} <> 0) AS backlog FROM memories GROUP BY phase" for n, b in ingest.CONSUMERS.items()))
def a3_consumers(spark, d):
    return stats.consumer_matrix(records(spark, d))


@query("SELECT count(*) FILTER (created_at > TIMESTAMP '2026-06-30') AS recent, count(*) FILTER (expires_at IS NOT NULL AND expires_at <= TIMESTAMP '2026-07-02') AS expiring, count(*) AS total FROM memories")
def a4_recent(spark, d):
    return records(spark, d).agg(F.count_if(F.col("created_at") > F.lit(datetime(2026, 6, 30))).alias("recent"), F.count_if(F.col("expires_at") <= F.lit(datetime(2026, 7, 2))).alias("expiring"), F.count("*").alias("total"))


@query("SELECT created_at::DATE AS day, count(*) AS total, count(*) FILTER (phase = 'inbox') AS inbox, count(*) FILTER (phase = 'organized') AS organized FROM memories WHERE created_at IS NOT NULL GROUP BY 1")
def a6_daily(spark, d):
    return stats.daily(records(spark, d), "created_at")


@query("SELECT ingested_at::DATE AS day, source, count(*) AS n FROM raw_entries WHERE ingested_at IS NOT NULL GROUP BY 1, 2")
def a8_day_source(spark, d):
    return stats.by_day_and(table(spark, d, "raw_entries"), "ingested_at", "source")


@query("WITH d AS (SELECT ingested_at::DATE AS day, count(*) AS n FROM raw_entries WHERE ingested_at IS NOT NULL GROUP BY 1), m AS (SELECT max(n) m FROM d) SELECT day, n, (CASE WHEN n / m > 0.75 THEN 4 WHEN n / m > 0.5 THEN 3 WHEN n / m > 0.25 THEN 2 ELSE 1 END)::INT AS level FROM d, m")
def a9_heatmap(spark, d):
    return stats.heatmap(table(spark, d, "raw_entries"), "ingested_at")


@query("SELECT dayofweek(ts)::INT AS weekday, hour(ts)::INT AS hour, count(*) AS n FROM events GROUP BY 1, 2")
def a10_clock(spark, d):
    return stats.clock(table(spark, d, "events"), "ts")


@query("SELECT created_at::DATE AS day, project, count(*) AS n FROM memories WHERE created_at IS NOT NULL GROUP BY 1, 2")
def a11_timeline(spark, d):
    return stats.by_day_and(records(spark, d), "created_at", "project")


@query("SELECT count(*) AS rows, count(DISTINCT content_hash) AS contents, min(ingested_at) AS first, max(ingested_at) AS last, " + ", ".join(f"count(*) FILTER ({c} <> '') AS with_{c}" for c in ("session_id", "project", "message_uuid", "role", "model", "prompt_id")) + " FROM raw_entries")
def a12_log_stats(spark, d):
    return stats.log_stats(table(spark, d, "raw_entries"))


@query("SELECT session_id, max(project) AS project, count(*) AS n, min(created_at) AS first FROM memories WHERE session_id <> '' AND consumed_mask & 32 = 0 GROUP BY 1")
def a13_pending_sessions(spark, d):
    return sessions.pending(records(spark, d), 32)


@query("SELECT DISTINCT session_id FROM memories WHERE phase = 'inbox' AND session_id <> ''")
def a14_sessions(spark, d):
    return records(spark, d).where("phase = 'inbox' AND session_id <> ''").select("session_id").distinct()


@query("WITH r AS (SELECT lower(json_extract_string(metadata, '$.status')) s, coalesce(nullif(lower(trim(json_extract_string(metadata, '$.domain'))), ''), 'general') d FROM memories WHERE trim(json_extract_string(metadata, '$.status')) <> ''), g AS (SELECT d AS domain, count(*) FILTER (s = 'accepted') AS accepted, count(*) FILTER (s = 'rejected') AS rejected, count(*) FILTER (s = 'pending') AS pending, count(*) AS total FROM r GROUP BY 1) SELECT *, total - accepted - rejected - pending AS ignored, round(CASE WHEN total > pending THEN accepted / (total - pending) END, 6) AS accept_rate, round(accepted / total, 6) AS profile_rate FROM g")
def a18_evidence(spark, d):
    return stats.verdict_evidence(records(spark, d))


LEDGER = "(SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type, props ORDER BY ts, event_id) <= 300000000, false) AS repeat FROM events)"


@query(f"SELECT event_type AS fn, count(*) AS calls, round(coalesce(sum(value), 0), 4) AS tokens, count(*) FILTER (repeat) AS repeats, count(*) FILTER (event_type = 'error') AS errors FROM {LEDGER} GROUP BY 1")
def a20_usage(spark, d):
    return usage.rollup(usage.with_repeats(calls(spark, d), ("session", "fn", "context")), ["fn"])


@query("WITH c AS (SELECT event_type AS fn, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) a, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 300000000 PRECEDING AND CURRENT ROW) b FROM events) SELECT fn, max(a) AS in_1_min, max(b) AS in_5_min FROM c GROUP BY 1 HAVING max(a) > 2 OR max(b) > 5")
def a21_over_frequency(spark, d):
    return usage.over_frequency(calls(spark, d), short=2, long=5)


@query("SELECT kind, count(*) AS n FROM entities GROUP BY 1")
def a22_kinds(spark, d):
    return table(spark, d, "entities").groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT project, count(*) AS n, round(avg(CASE WHEN consumed_mask & 2 <> 0 THEN 1 ELSE 0 END), 6) AS ratio FROM memories WHERE phase = 'organized' AND project <> '' GROUP BY 1 HAVING count(*) >= 5 AND avg(CASE WHEN consumed_mask & 2 <> 0 THEN 1 ELSE 0 END) <= 0.8 ORDER BY n DESC, project LIMIT 2")
def a24_candidates(spark, d):
    return stats.consolidation_candidates(records(spark, d), 2)


@query("SELECT project, arg_max(id, struct_pack(created_at, id)) AS newest, max(created_at) AS at FROM memories WHERE project <> '' AND created_at IS NOT NULL GROUP BY 1")
def a27_newest_per_project(spark, d):
    return records(spark, d).where("project <> '' AND created_at IS NOT NULL").groupBy("project").agg(F.max_by("id", F.struct("created_at", "id")).alias("newest"), F.max("created_at").alias("at"))


# --- sessions and order ---------------------------------------------------------------------------------------------


@query("""WITH l AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 1800000000 THEN 0 ELSE 1 END f FROM events),
s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) k FROM l) SELECT user_id, k::BIGINT AS session_no, count(*) AS n, min(ts) AS started, max(ts) AS ended FROM s GROUP BY 1, 2""")
def w2_gap_sessions(spark, d):
    s = sessions.gap_sessions(table(spark, d, "events"), "user_id", "ts", "event_id")
    return s.groupBy("user_id", F.col("session_no").cast("long").alias("session_no")).agg(F.count("*").alias("n"), F.min("ts").alias("started"), F.max("ts").alias("ended"))


@query("""WITH r AS (SELECT id, session_id, created_at, CASE WHEN coalesce(prompt_id, '') = '' THEN 'r' || id ELSE 'p' || prompt_id END p FROM memories WHERE session_id <> '' AND created_at IS NOT NULL),
f AS (SELECT *, min(struct_pack(created_at, id)) OVER (PARTITION BY session_id, p) m FROM r) SELECT id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY m, created_at, id)::INT AS place FROM f""")
def w3_prompt_order(spark, d):
    return sessions.prompt_order(records(spark, d).where("session_id <> '' AND created_at IS NOT NULL")).select("id", "session_id", "place")


@query()
def w4_chunks(spark, d):
    m = records(spark, d).where("session_id <> '' AND content IS NOT NULL").select("session_id", "id", F.octet_length("content").alias("bytes"))
    return sessions.chunks(m, "session_id", "id", "bytes", max_items=20, max_bytes=2_000)


@query("SELECT event_id AS id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) <= 300000000 AS repeat FROM events QUALIFY repeat")
def w7_repeats(spark, d):
    return usage.with_repeats(calls(spark, d), ("session", "fn")).where("repeat").select("id", "repeat")


@query("WITH d AS (SELECT DISTINCT project, created_at::DATE AS day FROM memories WHERE created_at IS NOT NULL), i AS (SELECT project, day - row_number() OVER (PARTITION BY project ORDER BY day)::INT g FROM d), r AS (SELECT project, count(*) n FROM i GROUP BY project, g) SELECT project, sum(n)::BIGINT AS active_days, max(n) AS longest_streak FROM r GROUP BY 1")
def w8_streaks(spark, d):
    return stats.streaks(records(spark, d), "project", "created_at")


@query("SELECT id, session_id FROM memories WHERE session_id <> '' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC NULLS LAST, id) <= 3")
def w13_newest_per_session(spark, d):
    return sessions.newest_per(records(spark, d).where("session_id <> ''"), "session_id", "created_at", "id", 3).select("id", "session_id")


@query("""WITH RECURSIVE m AS (SELECT message_uuid u, nullif(parent_uuid, '') p, nullif(prompt_id, '') q, seq FROM raw_entries WHERE length(message_uuid) = 36 QUALIFY row_number() OVER (PARTITION BY message_uuid ORDER BY seq) = 1),
w AS (SELECT u, p, q, 0 k FROM m UNION ALL SELECT w.u, m.p, m.q, k + 1 FROM w JOIN m ON w.p = m.u WHERE w.q IS NULL AND k < 400)
SELECT u AS message_uuid, max(q) AS prompt FROM w GROUP BY u""")
def j9_inherited_prompts(spark, d):
    raw = table(spark, d, "raw_entries").where(F.length("message_uuid") == 36)
    one = raw.groupBy("message_uuid").agg(F.min_by(F.struct("parent_uuid", "prompt_id"), "seq").alias("v")).select("message_uuid", "v.*")
    return sessions.inherited_prompts(one)


@query()
def j9_prompts_by_key(spark, d):
    """j9_inherited_prompts compares ids as stored and leaves out those of another length; here all messages take part."""
    return sessions.inherited_prompts(sessions.one_per_message(table(spark, d, "raw_entries")))


@query("SELECT session_id, min(created_at) AS first_seen, max(created_at) AS last_seen, count(*) AS records, count(DISTINCT project) AS projects, max(project) AS project FROM memories WHERE session_id <> '' GROUP BY 1")
def r11_session_views(spark, d):
    return state.session_views(records(spark, d))


@query("SELECT project, arg_max(id, struct_pack(updated_at, id)) AS id, round((date_diff('microsecond', max(updated_at), TIMESTAMP '2026-07-01') // 1000000) / 3600.0, 4) AS age_hours, date_diff('microsecond', max(updated_at), TIMESTAMP '2026-07-01') / 3600000000.0 > 24 AS stale FROM memories WHERE project <> '' AND updated_at IS NOT NULL GROUP BY 1")
def s25_project_states(spark, d):
    h = records(spark, d).where("project <> '' AND updated_at IS NOT NULL").select("project", "id", "updated_at", F.struct("updated_at", "id").alias("o"))
    return state.age(state.latest(h, "project", "o"), "updated_at", AS_OF).select("project", "id", "age_hours", "stale")


# --- joins and graphs -----------------------------------------------------------------------------------------------


@query("SELECT e.id, e.name, e.kind, count(DISTINCT m.memory_id) AS n FROM entities e LEFT JOIN entity_mentions m ON m.entity_id = e.id GROUP BY 1, 2, 3")
def j8_mention_counts(spark, d):
    return graph.mention_counts(table(spark, d, "entities"), table(spark, d, "entity_mentions"))


TOP = "t AS (SELECT e.id, count(DISTINCT m.memory_id) AS n FROM entities e JOIN entity_mentions m ON m.entity_id = e.id WHERE length(name) <= 40 AND NOT contains(name, '[[') GROUP BY 1 HAVING count(m.memory_id) > 0 ORDER BY n DESC, e.id LIMIT 30)"


@query("WITH " + TOP + " SELECT id, n FROM t")
def j7_top_entities(spark, d):
    return graph.top_entities(table(spark, d, "entities"), table(spark, d, "entity_mentions")).select("id", "n")


@query("WITH " + TOP + ", m AS (SELECT DISTINCT entity_id e, memory_id m FROM entity_mentions WHERE entity_id IN (SELECT id FROM t) AND memory_id IS NOT NULL) SELECT x.e AS a, y.e AS b, count(*) AS weight FROM m x JOIN m y ON x.m = y.m AND x.e < y.e GROUP BY 1, 2 HAVING count(*) >= 2")
def g2_entity_graph(spark, d):
    m = table(spark, d, "entity_mentions")
    return graph.entity_edges(graph.top_entities(table(spark, d, "entities"), m), m)


@query("WITH " + TOP + ", s AS (SELECT id FROM t ORDER BY n DESC, id LIMIT 3), m AS (SELECT DISTINCT entity_id e, memory_id m FROM entity_mentions WHERE entity_id IS NOT NULL AND memory_id IS NOT NULL), o AS (SELECT DISTINCT m FROM m WHERE e IN (SELECT id FROM s)) SELECT e AS id, count(*) AS weight FROM m WHERE m IN (SELECT m FROM o) AND e NOT IN (SELECT id FROM s) GROUP BY 1 ORDER BY weight DESC, id LIMIT 20")
def g3_neighbours(spark, d):
    m = table(spark, d, "entity_mentions")
    return graph.neighbours(m, graph.top_entities(table(spark, d, "entities"), m, 3), 20)


HITS = "h AS (SELECT id, content FROM memories WHERE phase <> 'inbox' AND contains(lower(content), 'rollback') ORDER BY created_at DESC NULLS LAST, id LIMIT 200)"


@query(f"WITH {HITS}, w AS (SELECT id, unnest({TERMS.format('content')}) t FROM h), n AS (SELECT t, count(*) df FROM w WHERE t NOT IN ({GRAPH_STOP}) AND NOT regexp_matches(t, '^[0-9]+$') GROUP BY 1 HAVING count(*) >= 3 ORDER BY df DESC, t LIMIT 20), k AS (SELECT w.id, w.t FROM w JOIN n ON n.t = w.t) SELECT x.t AS a, y.t AS b, count(*) AS weight FROM k x JOIN k y ON x.id = y.id AND x.t < y.t GROUP BY 1, 2 HAVING count(*) >= 2")
def g4_term_graph(spark, d):
    h = search.newest(records(spark, d).where((F.col("phase") != "inbox") & F.contains(F.lower("content"), F.lit("rollback"))), 200)
    return graph.term_graph(h.select("id", "content"))[1]


@query(r"""WITH k AS (SELECT lower(regexp_replace(name, '^\s+|\s+$', '', 'g')) k, 0 r, id FROM entities UNION ALL SELECT lower(regexp_replace(a, '^\s+|\s+$', '', 'g')), 1, id FROM (SELECT id, unnest(aliases) a FROM entities)),
b AS (SELECT k, min(struct_pack(r, id)) m FROM k WHERE k <> '' GROUP BY 1) SELECT t.mention_text, b.m.id AS entity_id FROM (SELECT DISTINCT mention_text FROM entity_mentions) t LEFT JOIN b ON b.k = lower(regexp_replace(t.mention_text, '^\s+|\s+$', '', 'g')) WHERE regexp_replace(t.mention_text, '^\s+|\s+$', '', 'g') <> ''""")
def j15_resolve_mentions(spark, d):
    return graph.resolve_mentions(table(spark, d, "entities"), table(spark, d, "entity_mentions"))


@query("SELECT m.id, m.phase, e.seq FROM memories m JOIN (SELECT id, min(seq) seq FROM raw_entries GROUP BY 1) e ON e.id = m.raw_entry_id")
def j4_lineage(spark, d):
    e = table(spark, d, "raw_entries").groupBy("id").agg(F.min("seq").alias("seq")).withColumnRenamed("id", "raw_entry_id")
    return records(spark, d).join(e, "raw_entry_id").select("id", "phase", "seq")


@query("SELECT r.seq FROM raw_entries r WHERE NOT EXISTS (SELECT 1 FROM memories m WHERE m.raw_entry_id = r.id)")
def j16_not_derived(spark, d):
    seen = records(spark, d).where("raw_entry_id IS NOT NULL").select(F.col("raw_entry_id").alias("id")).distinct()
    return table(spark, d, "raw_entries").join(seen, "id", "left_anti").select("seq")


@query(f"""WITH r AS (SELECT id, created_at, coalesce(phase, '') || chr(1) || coalesce(category, '') || chr(1) || coalesce(project, '') g, {TERMS.format("coalesce(content, '')")} ts FROM memories WHERE phase <> 'inbox' AND created_at IS NOT NULL)
SELECT a.id, arg_min(b.id, struct_pack(b.created_at, b.id)) AS superseded_by FROM r a JOIN r b ON a.g = b.g AND a.created_at < b.created_at AND len(list_intersect(a.ts, b.ts)) >= 3 GROUP BY 1""")
def v1_superseded(spark, d):
    return versioning.superseded(records(spark, d))


@query("WITH f AS (SELECT substr(trim(regexp_replace(replace(replace(lower(content), chr(10), ' '), chr(13), ''), ' {2,}', ' ', 'g')), 1, 200) fp, id, created_at FROM memories WHERE content IS NOT NULL) SELECT arg_min(id, struct_pack(a := created_at IS NULL, b := -epoch_us(created_at), c := id)) AS id, count(*) AS n FROM f GROUP BY fp")
def v3_fingerprint_dedup(spark, d):
    return versioning.unique_by_fingerprint(records(spark, d)).select("id", "n")


@query("SELECT id FROM memories WHERE contains(lower(content), 'rollback') AND contains(lower(content), 'kernel')")
def j12_relation(spark, d):
    return records(spark, d).where(F.contains(F.lower("content"), F.lit("rollback")) & F.contains(F.lower("content"), F.lit("kernel"))).select("id")


@query("SELECT DISTINCT project FROM memories WHERE project <> '' UNION SELECT DISTINCT project FROM documents WHERE project <> ''")
def u1_projects(spark, d):
    return records(spark, d).select("project").union(table(spark, d, "documents").select("project")).where("project <> ''").distinct()


# --- more operators of the same families ----------------------------------------------------------------------------


@query("SELECT id, CASE WHEN phase = 'inbox' THEN created_at + INTERVAL 168 HOUR END AS expires_at, coalesce(nullif(scope, ''), 'global') AS scope FROM memories")
def d5_inbox_defaults(spark, d):
    return records(spark, d).select("id", F.when(F.col("phase") == "inbox", F.col("created_at") + F.expr("INTERVAL 168 HOURS")).alias("expires_at"), F.coalesce(F.nullif("scope", F.lit("")), F.lit("global")).alias("scope"))


@query("SELECT id, CASE WHEN phase = 'inbox' THEN 'processed' ELSE phase END AS phase, CASE WHEN phase = 'inbox' THEN NULL ELSE expires_at END AS expires_at FROM memories")
def d8_phase_transition(spark, d):
    inbox = F.col("phase") == "inbox"
    return records(spark, d).select("id", F.when(inbox, "processed").otherwise(F.col("phase")).alias("phase"), F.when(~inbox, F.col("expires_at")).alias("expires_at"))


@query(r"""WITH m AS (SELECT id, regexp_replace(category, '^[ \[\]]+|[ \[\]]+$', '', 'g') c, content FROM memories) SELECT id, c IN ('preferences','decisions','lessons','reminders','habits','skills','feedback','knowledge','people','character','soul','projects','tasks','goals','values','relationships','inbox') AS standard FROM m WHERE c <> ''""")
def d15_category_audit(spark, d):
    c = T.normal_category(F.col("category"))
    return records(spark, d).where("category <> ''").select("id", c.isin(*ingest.CATEGORIES).alias("standard"))


@query("SELECT id, created_at FROM memories WHERE created_at >= '2025-06-01' AND created_at <= '2025-06-30' AND source NOT IN ('claude', 'obsidian') AND NOT contains(content, '[[') AND length(content) <= 400")
def pred_range(spark, d):
    r = records(spark, d).where(F.col("created_at").between(F.lit(datetime(2025, 6, 1)), F.lit(datetime(2025, 6, 30))) & ~F.col("source").isin("claude", "obsidian"))
    return r.where(~F.contains("content", F.lit("[[")) & (F.length("content") <= 400)).select("id", "created_at")


@query("SELECT m.id FROM memories m WHERE EXISTS (SELECT 1 FROM entity_mentions e JOIN entities n ON n.id = e.entity_id WHERE e.memory_id = m.id AND n.kind = 'person')")
def pred_semi_join(spark, d):
    people = table(spark, d, "entities").where("kind = 'person'").select(F.col("id").alias("entity_id"))
    m = table(spark, d, "entity_mentions").join(people, "entity_id", "left_semi").select(F.col("memory_id").alias("id"))
    return records(spark, d).join(m, "id", "left_semi").select("id")


LINKS = r"""l AS (SELECT DISTINCT doc_id AS s, lower(regexp_replace(t, '^\s+|\s+$', '', 'g')) AS t FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?s)\[\[(.*?)\]\]', 1)) t FROM documents) WHERE regexp_replace(t, '^\s+|\s+$', '', 'g') <> ''),
p AS (SELECT lower(project) t, arg_min(doc_id, struct_pack(created_at, doc_id)) g FROM documents WHERE project <> '' AND created_at IS NOT NULL GROUP BY 1),
e AS (SELECT s AS source, g AS target FROM l JOIN p USING (t) WHERE s <> g), b AS (SELECT source, target FROM e UNION SELECT target, source FROM e)"""


def _edges(spark, d):
    return graph.resolved_links(documents(spark, d).where("created_at IS NOT NULL OR content IS NOT NULL"), F.when(F.col("created_at").isNotNull(), F.lower("project")))


@query("WITH " + LINKS + " SELECT source, target FROM b")
def j6_backlinks(spark, d):
    return _edges(spark, d)


@query("WITH " + LINKS + " SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM b WHERE source % 3 <> 0 AND target % 3 <> 0")
def g1_record_graph(spark, d):
    return graph.undirected(_edges(spark, d), documents(spark, d).where("id % 3 <> 0"))


@query()
def g1_all_records(spark, d):
    """The link graph over all documents; g1_record_graph, as its SQL, keeps two thirds of them as nodes."""
    return graph.undirected(_edges(spark, d), documents(spark, d))


@query("WITH " + LINKS + " SELECT source AS id, count(*) AS links FROM b GROUP BY 1")
def g8_link_counts(spark, d):
    return _edges(spark, d).groupBy(F.col("source").alias("id")).agg(F.count("*").alias("links"))


@query("WITH " + TOP + ", s AS (SELECT id FROM t ORDER BY n DESC, id LIMIT 1) SELECT id, created_at FROM memories WHERE id IN (SELECT memory_id FROM entity_mentions WHERE entity_id IN (SELECT id FROM s)) ORDER BY created_at DESC NULLS LAST, id LIMIT 20")
def g5_entity_records(spark, d):
    m = table(spark, d, "entity_mentions")
    top = graph.top_entities(table(spark, d, "entities"), m, 1).select(F.col("id").alias("entity_id"))
    return search.newest(records(spark, d).join(m.join(top, "entity_id", "left_semi").select(F.col("memory_id").alias("id")), "id", "left_semi"), 20).select("id", "created_at")


@query("SELECT phase, count(*) AS n, max(length(content)) AS longest FROM memories GROUP BY ROLLUP(phase)")
def a15_totals(spark, d):
    return records(spark, d).rollup("phase").agg(F.count("*").alias("n"), F.max(F.length("content")).cast("long").alias("longest"))


@query(f"""WITH h AS (SELECT id, content, created_at FROM memories WHERE contains(lower(content), 'rollback') ORDER BY created_at DESC NULLS LAST, id LIMIT 40), w AS (SELECT unnest({TERMS.format('content')}) t FROM h)
SELECT t AS term, count(*) AS df FROM w WHERE t NOT IN ({GRAPH_STOP}, 'rollback') AND NOT regexp_matches(t, '^[0-9]+$') AND length(t) >= 2 GROUP BY 1 HAVING count(*) >= greatest(3, (SELECT count(*) FROM h) // 2) ORDER BY df DESC, t LIMIT 5""")
def a17_frequent_terms(spark, d):
    h = search.newest(records(spark, d).where(F.contains(F.lower("content"), F.lit("rollback"))), 40)
    return search.frequent_terms(h, ["rollback"])


@query("SELECT coalesce(nullif(project, ''), '(none)') AS project, count(*) AS n, string_agg(id, ' ' ORDER BY id) AS ids FROM memories WHERE phase = 'processed' GROUP BY 1")
def a23_groups(spark, d):
    return records(spark, d).where("phase = 'processed'").groupBy(F.coalesce(F.nullif("project", F.lit("")), F.lit("(none)")).alias("project")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("id")), " ").alias("ids"))


@query("SELECT id, array_to_string(list_sort(tags), ' ') AS tags, (SELECT count(DISTINCT entity_id) FROM entity_mentions e WHERE e.memory_id = m.id) AS entities FROM memories m")
def j17_scalar_subquery(spark, d):
    n = table(spark, d, "entity_mentions").groupBy(F.col("memory_id").alias("id")).agg(F.count_distinct("entity_id").alias("entities"))
    return records(spark, d).join(n, "id", "left").select("id", F.array_join(F.array_sort("tags"), " ").alias("tags"), F.coalesce("entities", F.lit(0)).alias("entities"))


@query("""WITH r AS (SELECT seq, session_id s, nullif(prompt_id, '') q FROM raw_entries WHERE session_id <> ''), l AS (SELECT seq, s, q, last_value(q IGNORE NULLS) OVER (PARTITION BY s ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) p FROM r)
SELECT seq, s AS session_id FROM l WHERE q IS NOT NULL AND q IS DISTINCT FROM p""")
def w6_first_turns(spark, d):
    r = table(spark, d, "raw_entries").where("session_id <> ''").select("seq", "session_id", F.nullif("prompt_id", F.lit("")).alias("q"))
    before = F.last("q", ignorenulls=True).over(W.partitionBy("session_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1))
    return r.withColumn("p", before).where("q IS NOT NULL AND NOT q <=> p").select("seq", "session_id")


@query("SELECT id, session_id FROM (SELECT id, session_id, sum(length(content)) OVER (PARTITION BY session_id ORDER BY created_at DESC NULLS LAST, id ROWS UNBOUNDED PRECEDING) u FROM memories WHERE session_id <> '' AND content IS NOT NULL) WHERE u <= 1500")
def w15_history_trim(spark, d):
    run = F.sum(F.length("content")).over(W.partitionBy("session_id").orderBy(F.col("created_at").desc_nulls_last(), "id").rowsBetween(W.unboundedPreceding, 0))
    return records(spark, d).where("session_id <> '' AND content IS NOT NULL").withColumn("u", run).where("u <= 1500").select("id", "session_id")


@query("SELECT project, max(updated_at) FILTER (phase = 'organized') AS profile, max(created_at) AS signal, coalesce(max(created_at) > max(updated_at) FILTER (phase = 'organized'), true) AS fresh FROM memories WHERE project <> '' GROUP BY 1")
def w16_new_signal(spark, d):
    profile = F.max(F.when(F.col("phase") == "organized", F.col("updated_at")))
    return records(spark, d).where("project <> ''").groupBy("project").agg(profile.alias("profile"), F.max("created_at").alias("signal")).withColumn("fresh", F.coalesce(F.col("signal") > F.col("profile"), F.lit(True)))


@query("SELECT id FROM memories WHERE coalesce(json_extract_string(metadata, '$.superseded_by'), '') <> '' OR coalesce(json_extract_string(metadata, '$.superseded'), '') = 'true'")
def v2_is_superseded(spark, d):
    return records(spark, d).where(versioning.is_superseded(F.col("metadata"))).select("id")


@query("SELECT id, trigger_at FROM (SELECT id, CASE WHEN phase = 'inbox' THEN 'pending' ELSE 'done' END status, expires_at trigger_at FROM memories) WHERE status = 'pending' AND trigger_at <= TIMESTAMP '2026-01-01'")
def r13_due(spark, d):
    r = records(spark, d).select("id", F.when(F.col("phase") == "inbox", "pending").otherwise("done").alias("status"), F.col("expires_at").alias("trigger_at"))
    return state.due(r, datetime(2026, 1, 1)).select("id", "trigger_at")


@query("SELECT id, created_at FROM memories WHERE phase IN ('organized', 'processed') AND consumed_mask & 4 = 0 ORDER BY created_at, id LIMIT 100")
def r3_backlog(spark, d):
    r = records(spark, d).where(F.col("phase").isin("organized", "processed") & ingest.is_pending(F.col("consumed_mask"), "enrich-tags"))
    return r.orderBy("created_at", "id").limit(100).select("id", "created_at")


@query("SELECT string_agg(content, chr(10) ORDER BY created_at DESC, id) AS context FROM (SELECT id, content, created_at FROM memories WHERE contains(lower(content), 'rollback') AND created_at IS NOT NULL ORDER BY created_at DESC, id LIMIT 5)")
def q16_context(spark, d):
    top = search.newest(records(spark, d).where(F.contains(F.lower("content"), F.lit("rollback")) & F.col("created_at").isNotNull()), 5)
    key = F.struct((-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("o"), "id", "content")
    return top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["content"]), "\n").alias("context"))


@query("SELECT session_id, project, last_seen FROM (SELECT session_id, max(project) project, max(created_at) last_seen FROM memories WHERE session_id <> '' GROUP BY 1) WHERE contains(lower(project), 'tor') OR contains(lower(project), 'iron') ORDER BY last_seen DESC NULLS LAST, session_id LIMIT 5")
def q11_session_views(spark, d):
    v = state.session_views(records(spark, d))
    hit = F.contains(F.lower("project"), F.lit("tor")) | F.contains(F.lower("project"), F.lit("iron"))
    return v.where(hit).orderBy(F.col("last_seen").desc_nulls_last(), "session_id").limit(5).select("session_id", "project", "last_seen")


@query("SELECT seq, source, CASE WHEN length(content) > 72 THEN content[1:72] || '...' ELSE content END AS preview FROM raw_entries WHERE starts_with(id, 'a') ORDER BY seq LIMIT 20")
def s7_event_viewer(spark, d):
    return table(spark, d, "raw_entries").where(F.col("id").startswith("a")).orderBy("seq").limit(20).select("seq", "source", T.preview(F.col("content")).alias("preview"))


@query("SELECT project, phase, count(*) AS n FROM memories WHERE project <> '' GROUP BY project, phase")
def s24_sql(spark, d):
    """Any SELECT over the store, by a temporary view."""
    records(spark, d).createOrReplaceTempView("memories")
    return spark.sql("SELECT project, phase, count(*) AS n FROM memories WHERE project <> '' GROUP BY project, phase")


@query("WITH s AS (SELECT project AS entity, session_id AS task, max(created_at) AS last_seen FROM memories WHERE session_id <> '' AND project <> '' GROUP BY 1, 2), st AS (SELECT project, min(updated_at) AS updated_at FROM memories WHERE project <> '' GROUP BY 1), h AS (SELECT lower(entity) AS project, max(last_seen) AS last_work, arg_max(task, struct_pack(last_seen, task)) AS task FROM s WHERE last_seen >= TIMESTAMP '2026-07-01' - INTERVAL 90 DAY GROUP BY 1) SELECT h.project, st.updated_at AS last_state, h.last_work, h.task, round((date_diff('microsecond', st.updated_at, h.last_work) // 1000000) / 3600.0, 4) AS delta_hours FROM h LEFT JOIN st ON st.project = h.project WHERE st.updated_at IS NULL OR h.last_work > st.updated_at")
def j14_coverage(spark, d):
    r = records(spark, d).where("project <> ''")
    s = r.where("session_id <> ''").groupBy(F.col("project").alias("entity"), F.col("session_id").alias("task")).agg(F.max("created_at").alias("last_seen"))
    st = r.groupBy("project").agg(F.min("updated_at").alias("updated_at"))
    names = st.select("project", F.col("project").alias("alias"))
    gaps = state.coverage_gaps(s.withColumn("task", F.concat(F.lit("#"), "task")), st, names, AS_OF, 90)
    return gaps.select("project", "last_state", "last_work", F.expr("substring(task, 2)").alias("task"), "delta_hours")


@query()
def r_stream_event_log(spark, d):
    """The first event of every content, built by a stream of micro-batches."""
    from mnemolith.streaming.delivery import _glob
    from mnemolith.streaming.pipeline import consume
    from mnemolith.util import scratch

    path, out = f"{d}/raw_entries.parquet", scratch(spark, "event-log")
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(_glob(path))
    consume(stream, lambda b: ingest.event_log(b.select("seq", "content")), out, scratch(spark, "event-log-state")).awaitTermination()
    return spark.read.schema("hash string, seq long, content string, deliveries long").parquet(f"{out}/batch=*").groupBy("hash").agg(F.min("seq").alias("seq"), F.sum("deliveries").alias("deliveries"))


SQL["r_stream_event_log"] = SQL["d2_event_log"]
