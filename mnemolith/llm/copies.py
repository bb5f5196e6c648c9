"""Problem 5: records that say the same in different dress.

The canonical form keeps the letters and digits of the lower-cased text in order; a text of named fields has a second
form, its canonical fields sorted by name and value. Both are hashed to 128 bits and counted with map-side combining;
the collision check compares length and a second, independent 64-bit hash of every member of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolith.operators.components import components
from mnemolith.util import materialise, spread

NOT_WORD = r"[^\p{L}\p{N}]+"


def plain_form(content: Column) -> Column:
    """Letters and digits of the lower-cased text, in order."""
    return F.regexp_replace(F.lower(content), NOT_WORD, "")


#: Whole-text shapes of the notations of named fields; prose fails them at its first part, so only records are split.
JSON_SHAPE = r"(?s)^\s*\{.*\}\s*$"
LINES_SHAPE = r"^(?:\s*[^:\n]{1,80}:[^\n]*(?:\n|$)){2,}\s*$"
PAIRS_SHAPE = r"^\s*[^={0}]{{1,80}}={1}(?:{2}\s*[^={0}]{{1,80}}={1})+[{0}]?\s*$"
COLON_SHAPE = r"^\s*[^:;|\n]{1,80}:[^;|\n]*(?:[;|\n]+\s*[^:;|\n]{1,80}:[^;|\n]*)+[;|]?\s*$"


def _fields(parts: Column, sep: str) -> Column:
    """Sorted 'name\\x01value' in plain form, or null if a part is no named field."""
    parts = F.filter(parts, lambda p: F.length(plain_form(p)) > 0)
    at = lambda p: F.locate(sep, p)
    named = F.transform(parts, lambda p: F.when(at(p) > 1, F.concat(plain_form(F.substring(p, F.lit(1), at(p) - 1)), F.lit("\x01"), plain_form(F.substring(p, at(p) + 1, F.length(p))))))
    good = F.forall(named, lambda x: x.isNotNull() & ~x.startswith("\x01") & ~x.endswith("\x01") & (F.length(F.substring_index(x, "\x01", 1)) <= 40))
    return F.when((F.size(named) >= 2) & good, F.array_sort(named))


def field_form(content: Column) -> Column:
    """Sorted named fields of a text that consists of them: JSON object, ``name=value; …``, or ``name: value`` lines.

    The same fields in another order or another of these notations have the same form. Null for any other text.
    """
    t = F.regexp_replace(content, r"^[\s\x{FEFF}\x{200B}]+|[\s\x{200B}]+$", "")
    json = F.from_json(t, "map<string,string>")
    pairs = F.transform(F.map_entries(json), lambda e: F.concat(plain_form(e["key"]), F.lit("\x01"), plain_form(e["value"])))
    from_json = F.when((F.size(pairs) >= 2) & F.forall(pairs, lambda x: x.isNotNull()), F.array_sort(pairs))
    semis = PAIRS_SHAPE.format(";\\n", "[^;\\n]*", "[;\\n]+")
    comma = PAIRS_SHAPE.format(",\\n", "[^,\\n]*", "[,\\n]+")
    found = (
        F.when(t.startswith("{") & t.rlike(JSON_SHAPE), from_json)
        .when(t.contains("\n") & t.rlike(LINES_SHAPE), _fields(F.split(t, r"\r?\n"), ":"))
        .when(t.contains("=") & t.rlike(semis), _fields(F.split(t, r"[;\r\n]+"), "="))
        .when(t.contains("=") & ~t.contains(";") & t.rlike(comma), _fields(F.split(t, r"[,\r\n]+"), "="))
        .when(t.contains(":") & t.rlike(COLON_SHAPE), _fields(F.split(t, r"[;|\r\n]+"), ":"))
    )
    return F.array_join(found, "\x02")


def forms(memories: DataFrame, id_col: str = "id", content: str = "content") -> DataFrame:
    """``id, kind, form`` for every non-null content; kind ``plain`` for all, ``fields`` where there are named fields."""
    rows = spread(memories.select(F.col(id_col).alias("id"), F.col(content).alias("t")).where("t IS NOT NULL"))
    return rows.select("id", F.explode(F.array(F.struct(F.lit("plain").alias("kind"), plain_form(F.col("t")).alias("form")), F.struct(F.lit("fields").alias("kind"), field_form(F.col("t")).alias("form")))).alias("x")).select("id", "x.kind", "x.form").where("form IS NOT NULL AND (kind = 'plain' OR form <> '')")


def hashed(memories: DataFrame, **names: str) -> DataFrame:
    """``id, kind, h`` (128 bits as binary) plus ``len, h2`` for the collision check."""
    return forms(memories, **names).select("id", "kind", F.unhex(F.md5(F.concat_ws("\x03", "kind", "form"))).alias("h"), F.length("form").alias("len"), F.xxhash64("form").alias("h2"))


def collapse(memories: DataFrame) -> DataFrame:
    """One row per distinct plain form, field order left out (see ``collapse_dress``): ``id`` (smallest of the copies), ``copies``, ``clean`` (no hash collision found).

    Null contents take no part; contents without any letter or digit form one group. Counting is a hash aggregate with
    map-side combining, so a form that holds a third of all rows is no hot group.
    """
    return hashed(memories).where("kind = 'plain'").groupBy("h").agg(F.min("id").alias("id"), F.count("*").alias("copies"), ((F.min("len") == F.max("len")) & (F.min("h2") == F.max("h2"))).alias("clean")).select("id", "copies", "clean")


def collapse_dress(memories: DataFrame) -> DataFrame:
    """One row per set of records that differ only in dress, order of named fields included: ``id`` (smallest), ``copies``.

    Plain forms are classed together where they share a field form, and the classes close to components, as the pairs
    of ``copy_pairs`` do. Texts are read once and counted by both forms map-side; only field forms that go with several
    plain forms are edges, so most forms never enter the components. Keys are hash, length and second hash together.
    Null contents take no part; contents without any letter or digit form one set.
    """
    rows = spread(memories.select("id", F.col("content").alias("t")).where("t IS NOT NULL"))
    rows = rows.select("id", plain_form(F.col("t")).alias("plain"), F.nullif(field_form(F.col("t")), F.lit("")).alias("fields"))
    key = lambda kind: F.when(F.col(kind).isNotNull(), F.concat_ws("|", F.lit(kind), F.md5(F.col(kind)), F.length(kind), F.xxhash64(kind)))
    by = materialise(rows.select("id", key("plain").alias("p"), key("fields").alias("f")).groupBy("p", "f").agg(F.min("id").alias("id"), F.count("*").alias("n")), "dress")
    edges = by.where("f IS NOT NULL").select("p", "f")
    shared = edges.groupBy("f").agg(F.count("*").alias("k")).where("k > 1").select("f")
    classes = components(edges.join(shared, "f", "left_semi").select(F.col("p").alias("u"), F.col("f").alias("v"))).select(F.col("node").alias("p"), "root")
    plain = by.groupBy("p").agg(F.min("id").alias("id"), F.sum("n").alias("n"))
    return plain.join(classes, "p", "left").groupBy(F.coalesce("root", "p").alias("root")).agg(F.min("id").alias("id"), F.sum("n").alias("copies")).select("id", "copies")


def copy_pairs(memories: DataFrame) -> DataFrame:
    """All pairs ``memory_a < memory_b`` with the same plain form or the same named fields.

    Rows with a form of their own leave before any join: only repeated hashes, found by a map-side combined count, are
    paired. The pairs themselves are the result, so a group of k copies has k(k-1)/2 rows; they are produced by a join
    on the hash, which adaptive execution splits if one hash is skewed.
    """
    h = hashed(memories).select("id", "kind", "h", "len", "h2")
    groups = h.groupBy("h", "len", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h", "len", "h2")
    members = h.join(groups, ["h", "len", "h2"], "left_semi").select("id", "h", "h2")
    a, b = members.select(F.col("id").alias("memory_a"), "h", "h2"), members.select(F.col("id").alias("memory_b"), "h", "h2")
    return a.join(b, ["h", "h2"]).where("memory_a < memory_b").select("memory_a", "memory_b").distinct()
