"""Graphs: wiki links, record links, entity mentions and co-occurrence, content terms, entity merging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolith.functions import text as T
from mnemolith.operators.components import components


def link_edges(records: DataFrame) -> DataFrame:
    """``source, target_title`` of every wiki link, lower case."""
    return records.select(F.col("id").alias("source"), F.explode(T.wiki_links(F.col("content"))).alias("t")).select("source", F.lower("t").alias("target_title")).distinct()


def resolved_links(records: DataFrame, title=None) -> DataFrame:
    """Directed edges in both directions between a record and the record its link names; of equal titles the oldest wins."""
    title = F.lower(T.title(F.col("content"))) if title is None else title
    titles = records.withColumn("_t", title).where("_t <> ''").groupBy("_t").agg(F.min_by("id", F.struct("created_at", "id")).alias("target"))
    e = link_edges(records).join(titles, F.col("target_title") == F.col("_t")).where("source <> target").select("source", "target")
    return e.unionByName(e.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()


def undirected(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges ``a < b`` inside the node set, each once."""
    n = nodes.select("id").distinct()
    e = edges.join(n.withColumnRenamed("id", "source"), "source", "left_semi").join(n.withColumnRenamed("id", "target"), "target", "left_semi")
    return e.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()


def mention_counts(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """``id, name, kind, n``: distinct memories per entity; entities without any keep 0."""
    n = mentions.where("entity_id IS NOT NULL AND memory_id IS NOT NULL").groupBy(F.col("entity_id").alias("id")).agg(F.count_distinct("memory_id").alias("n"))
    return entities.select("id", "name", "kind").join(n, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def top_entities(entities: DataFrame, mentions: DataFrame, k: int = 30) -> DataFrame:
    """The entities with most memories; names over 40 characters or with ``[[`` are no nodes."""
    ok = entities.where((F.length("name") <= 40) & ~F.contains("name", F.lit("[[")))
    return mention_counts(ok, mentions).where("n > 0").orderBy(F.desc("n"), "id").limit(k)


def entity_edges(top: DataFrame, mentions: DataFrame, least: int = 2) -> DataFrame:
    """Edges ``a < b, weight`` between the given few entities: memories they share. Only their mentions are paired."""
    m = mentions.where("memory_id IS NOT NULL").join(F.broadcast(top.select(F.col("id").alias("entity_id"))), "entity_id", "left_semi").select("entity_id", "memory_id").distinct()
    per = m.groupBy("memory_id").agg(F.array_sort(F.collect_set("entity_id")).alias("es")).where("size(es) > 1")  # at most as many as the few entities
    pairs = per.select(F.explode("es").alias("a"), "es").select("a", F.explode("es").alias("b")).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("weight")).where(F.col("weight") >= least)


def neighbours(mentions: DataFrame, seeds: DataFrame, k: int = 20) -> DataFrame:
    """Entities that share most memories with the seeds ``(id)``: ``id, weight``; seeds themselves are left out."""
    m = mentions.where("entity_id IS NOT NULL AND memory_id IS NOT NULL").select("entity_id", "memory_id").distinct()
    s = seeds.select(F.col("id").alias("entity_id")).distinct()
    own = m.join(s, "entity_id", "left_semi").select("memory_id").distinct()
    return m.join(own, "memory_id", "left_semi").join(s, "entity_id", "left_anti").groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("weight")).orderBy(F.desc("weight"), "id").limit(k)


def term_graph(hits: DataFrame, k: int = 20, least_df: int = 3, least_edge: int = 2) -> tuple[DataFrame, DataFrame]:
    """Nodes ``term, df`` and edges ``a < b, weight`` of the terms of a bounded set of hits."""
    words = hits.select("id", F.explode(T.terms(F.col("content"))).alias("term")).where(~T.is_graph_stop(F.col("term")))
    nodes = words.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= least_df).orderBy(F.desc("df"), "term").limit(k)
    per = words.join(F.broadcast(nodes), "term").groupBy("id").agg(F.collect_set("term").alias("ts"))
    pairs = per.select(F.explode("ts").alias("a"), "ts").select("a", F.explode("ts").alias("b")).where("a < b")
    return nodes, pairs.groupBy("a", "b").agg(F.count("*").alias("weight")).where(F.col("weight") >= least_edge)


def resolve_mentions(entities: DataFrame, texts: DataFrame) -> DataFrame:
    """``mention_text, entity_id``: by name, else by alias (smallest id of several), without letter case and blanks; unknown ones have null."""
    key = lambda c: F.lower(T.trim_space(F.col(c)))
    names = entities.select(key("name").alias("k"), F.lit(0).alias("r"), "id")
    alias = entities.select("id", F.explode("aliases").alias("a")).select(key("a").alias("k"), F.lit(1).alias("r"), "id")
    best = names.unionByName(alias).where("k <> ''").groupBy("k").agg(F.min(F.struct("r", "id")).alias("m"))
    return texts.select("mention_text").distinct().withColumn("k", key("mention_text")).where("k <> ''").join(best, "k", "left").select("mention_text", F.col("m.id").alias("entity_id"))


def merge_entities(entities: DataFrame, mentions: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply merges ``(source, target)``, also chains of them: sources vanish, their names become aliases, mentions move.

    Of a component the target that is no source stays, else the smallest id.
    """
    ok = merges.where("source IS NOT NULL AND target IS NOT NULL AND source <> target")
    comp = components(ok.select(F.col("source").alias("u"), F.col("target").alias("v")))
    tops = ok.select(F.col("target").alias("node")).join(ok.select(F.col("source").alias("node")), "node", "left_anti").distinct()
    keep = comp.join(tops.withColumn("top", F.lit(1)), "node", "left").groupBy("root").agg(F.coalesce(F.min(F.when(F.col("top") == 1, F.col("node"))), F.min("node")).alias("into"))
    to = comp.join(keep, "root").select(F.col("node").alias("id"), "into")
    e = entities.join(to, "id", "left").withColumn("into", F.coalesce("into", "id"))
    own = F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.when(F.col("into") != F.col("id"), F.array("name")).otherwise(F.array().cast("array<string>")))
    merged = e.groupBy("into").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(own)))).alias("aliases"))
    kept = entities.drop("aliases").join(merged.withColumnRenamed("into", "id"), "id")
    moved = mentions.join(to.withColumnRenamed("id", "entity_id"), "entity_id", "left").withColumn("entity_id", F.coalesce("into", "entity_id")).drop("into")
    return kept, moved


def link(edges: DataFrame, pairs: DataFrame, records: DataFrame) -> DataFrame:
    """``edges(source, target)`` with ``pairs(a, b)`` linked both ways; both ids must exist, repeated links count once."""
    ids = records.select("id").distinct()
    ok = pairs.where("a <> b").join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    both = ok.select(F.col("a").alias("source"), F.col("b").alias("target")).unionByName(ok.select(F.col("b").alias("source"), F.col("a").alias("target")))
    return edges.select("source", "target").unionByName(both).distinct()


def unlink(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``edges`` without ``pairs(a, b)`` in either direction."""
    gone = pairs.select(F.col("a").alias("source"), F.col("b").alias("target")).unionByName(pairs.select(F.col("b").alias("source"), F.col("a").alias("target")))
    return edges.join(gone.distinct(), ["source", "target"], "left_anti")
