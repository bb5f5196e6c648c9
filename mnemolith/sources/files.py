"""Readers of transcripts, rollouts, Markdown, vaults and JSONL, and writers of exports; one record schema for all.

Every reader returns ``content, source, project, session_id, message_uuid, parent_uuid, role, model, git_branch,
prompt_id, tags, created_at, path``; fields a format lacks are blank. Unreadable lines are skipped where the format is
a log, and end the read where it is an import.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemolith.functions import text as T

RECORD = ("content", "source", "project", "session_id", "message_uuid", "parent_uuid", "role", "model", "git_branch", "prompt_id", "tags", "created_at", "path")
TRANSCRIPT = "type string, uuid string, parentUuid string, sessionId string, timestamp string, cwd string, gitBranch string, promptId string, isCompactSummary boolean, isMeta boolean, isSidechain boolean, agentId string, message struct<role: string, model: string, content: string>"
ROLLOUT = "type string, sessionId string, startedAt string, model struct<modelId: string>, request struct<messages: array<struct<role: string, content: string>>>, response struct<text: string>"


def as_records(df: DataFrame, **columns: Column) -> DataFrame:
    """The record schema with the given columns; the others are blank."""
    blank = {"tags": F.array().cast("array<string>"), "created_at": F.lit(None).cast("timestamp")}
    return df.select(*[F.coalesce(columns[c], blank.get(c, F.lit(""))).alias(c) if c in columns else blank.get(c, F.lit("")).alias(c) for c in RECORD])


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))


def _lines(spark: SparkSession, path: str, glob: str, schema: str) -> DataFrame:
    """Parsed JSON lines with file path and line order; lines that are no objects are skipped."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path).select("value", F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("line"))
    return raw.select("path", "line", F.from_json("value", schema).alias("j")).where("j.type IS NOT NULL")


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Chat transcripts: user and assistant lines without meta and noise; prompt ids come down the parent chain."""
    from mnemolith.operators.sessions import inherited_prompts

    t = _lines(spark, path, "*.jsonl", TRANSCRIPT).select("path", "line", "j.*").where("type IN ('user', 'assistant') AND NOT coalesce(isMeta, false)")
    chain = inherited_prompts(t.where("uuid <> ''").groupBy("uuid").agg(F.first("parentUuid").alias("parent_uuid"), F.max("promptId").alias("prompt_id")).withColumnRenamed("uuid", "message_uuid"))
    t = t.join(chain.select(F.col("message_uuid").alias("uuid"), "prompt"), "uuid", "left").withColumn("content", T.block_text(F.col("message.content"))).where(~T.is_noise(F.col("content")))
    tags = F.filter(F.array(F.when(F.coalesce("isCompactSummary", F.lit(False)), F.lit("compact")), F.when(F.coalesce("isSidechain", F.lit(False)), F.lit("subagent")), F.when(F.coalesce("agentId", F.lit("")) != "", F.concat(F.lit("agent:"), "agentId"))), lambda x: x.isNotNull())
    return as_records(t, content=F.col("content"), source=F.lit("conversations"), project=T.project_from_path(F.col("cwd")), session_id=F.coalesce(F.nullif(F.col("sessionId"), F.lit("")), _stem(F.col("path"))), message_uuid=F.col("uuid"), parent_uuid=F.col("parentUuid"), role=F.coalesce("message.role", "type"), model=F.col("message.model"), git_branch=F.col("gitBranch"), prompt_id=F.col("prompt"), tags=tags, created_at=F.try_to_timestamp("timestamp"), path=F.col("path"))


def rollouts(spark: SparkSession, path: str) -> DataFrame:
    """Model rollouts: answers of 20 bytes at least; the last user prompt precedes the first answer to it as 'Q: … A: …'."""
    t = _lines(spark, path, "*.jsonl", ROLLOUT).where("j.type = 'model_io' AND octet_length(j.response.text) >= 20").select("path", "line", "j.*")
    asked = F.filter("request.messages", lambda m: (m["role"] == "user") & (F.trim(m["content"]) != "") & ~F.trim(m["content"]).startswith("<"))
    t = t.withColumn("q", F.when(F.size(asked) > 0, F.trim(F.element_at(asked, -1)["content"])))
    before = F.last("q", ignorenulls=True).over(W.partitionBy("path").orderBy("line").rowsBetween(W.unboundedPreceding, -1))
    t = t.withColumn("fresh", F.col("q").isNotNull() & ~F.col("q").eqNullSafe(before))
    body = F.when(F.col("fresh"), F.concat(F.lit("Q: "), "q", F.lit("\nA: "), "response.text")).otherwise(F.col("response.text"))
    return as_records(t, content=body, source=F.lit("rollouts"), session_id=F.coalesce("sessionId", _stem(F.col("path"))), role=F.lit("assistant"), model=F.col("model.modelId"), created_at=F.try_to_timestamp("startedAt"), path=F.col("path"))


def markdown_chunks(spark: SparkSession, path: str, source: str = "markdown", project: str = "") -> DataFrame:
    """Markdown files cut at ``## ``: front matter off, its ``name`` a tag; chunks that are a short heading only are dropped."""
    f = _files(spark, path, "*.md")
    front = F.regexp_extract("text", r"(?s)\A---\r?\n(.*?)\n---\r?\n", 1)
    name = F.lower(F.trim(F.regexp_extract(front, r"(?m)^name:\s*(.+)$", 1)))
    body = F.regexp_replace("text", r"(?s)\A---\r?\n.*?\n---\r?\n", "")
    c = f.select("path", name.alias("name"), F.explode(F.split(body, r"(?m)(?=^## )")).alias("chunk")).withColumn("chunk", T.trim_space(F.col("chunk")))
    c = c.where(~((F.octet_length("chunk") < 20) & (F.col("chunk").startswith("#") | (F.col("chunk") == ""))))
    return as_records(c, content=F.col("chunk"), source=F.lit(source), project=F.lit(project), tags=F.when(F.col("name") != "", F.array("name")), path=F.col("path"))


def vault_notes(spark: SparkSession, path: str, source: str = "vault", most: int = 10_000) -> DataFrame:
    """Notes of a vault: tags and aliases of the YAML front matter, the folder as a tag, wiki links lower case as tags;
    hidden and trash folders are left out. Contents are cut at ``most`` characters, as the format defines (null: whole)."""
    f = _files(spark, path, "*.md").where(~F.col("path").rlike(r"/\.(?:obsidian|trash|git)/"))
    front = F.regexp_extract("text", r"(?s)\A---\r?\n(.*?)\n---\r?\n", 1)
    lists = F.concat(*[F.concat(F.regexp_extract_all(F.regexp_extract(front, rf"(?m)^{k}:\s*\[(.*?)\]", 1), F.lit(r"[^,\s\[\]\"']+"), F.lit(0)), F.regexp_extract_all(F.regexp_extract(front, rf"(?m)^{k}:\s*\n((?:\s*-\s*.+\n?)+)", 1), F.lit(r"-\s*(.+)"), F.lit(1))) for k in ("tags", "aliases")])
    folder = F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1)
    body = T.trim_space(F.regexp_replace("text", r"(?s)\A---\r?\n.*?\n---\r?\n", ""))
    tags = T.normal_tags(F.transform(F.concat(lists, F.array(folder), T.wiki_links(body)), F.lower))
    return as_records(f, content=F.substring(body, 1, most) if most else body, source=F.lit(source), tags=tags, path=F.col("path")).where("content <> ''")


def journals(spark: SparkSession, path: str) -> DataFrame:
    """A journal vault: ``pages`` get their name, ``journals`` their date as a tag."""
    f = _files(spark, path, "*.md").where(F.col("path").rlike("/(?:pages|journals)/"))
    name = F.lower(_stem(F.col("path")))
    day = F.regexp_replace(name, "_", "-")
    tags = T.normal_tags(F.concat(F.array(F.when(F.col("path").contains("/journals/"), day).otherwise(name)), F.transform(T.wiki_links(F.col("text")), F.lower)))
    return as_records(f, content=T.trim_space(F.col("text")), source=F.lit("journal"), tags=tags, path=F.col("path")).where("content <> ''")


def chat_file(spark: SparkSession, path: str, most: int = 5_000) -> DataFrame:
    """One chat file as one record, cut at ``most`` characters as the format defines."""
    f = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))
    return as_records(f, content=F.substring(T.trim_space(F.col("text")), 1, most), source=F.lit("chat"), path=F.col("path"))


def import_jsonl(spark: SparkSession, path: str, preserve: bool = False) -> DataFrame:
    """Exported records; a malformed line ends the import. Phase is inbox unless ``preserve``."""
    df = spark.read.schema("id string, content string, scope string, tags array<string>, source string, phase string, category string, created_at timestamp").option("mode", "FAILFAST").json(path)
    return df if preserve else df.select("content", "scope", "tags", "source", F.lit("inbox").alias("phase"))


def export_jsonl(records: DataFrame, path: str, category: str | None = None, scope: str | None = None) -> None:
    """Records of a category and scope as JSON lines, written in parallel."""
    for c, v in (("category", category), ("scope", scope)):
        if v:
            records = records.where(F.col(c) == v)
    records.write.mode("overwrite").json(path)


def new_records(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """Incoming records whose content is not known yet (by hash), each content once."""
    h = incoming.withColumn("hash", T.content_hash(F.col("content")))
    return h.join(known.select(T.content_hash(F.col("content")).alias("hash")).distinct(), "hash", "left_anti").dropDuplicates(["hash"]).drop("hash")


READERS = {"transcripts": transcripts, "rollouts": rollouts, "markdown": markdown_chunks, "vault": vault_notes, "journal": journals, "chat": chat_file}


def read_all(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Union of the named sources; an unknown name is an error."""
    out = None
    for name, path in paths.items():
        if name not in READERS:
            raise ValueError(f"no source {name!r}; there are {sorted(READERS)}")
        df = READERS[name](spark, path)
        out = df if out is None else out.unionByName(df)
    if out is None:
        raise ValueError("no sources")
    return out
