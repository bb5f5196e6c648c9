"""Problem 4: rebuild whole conversations from message rows by pointer jumping.

A conversation that is kept is an unbranched chain, so only links whose parent has exactly one child are followed.
What remains are disjoint chains (and cycles): every pointer target is unique, hence no join key is ever hot, however
many messages hang on one parent. Each round doubles the distance a pointer spans, so a conversation of n messages
takes log2(n) rounds; messages left when a round resolves nothing lie on cycles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolith.operators.dedup import winners
from mnemolith.util import BLANKS, key_of, materialise, trim_blanks

#: Ways of writing a role (fixed values).
ROLES = {"user": "user", "human": "user", "assistant": "assistant", "ai": "assistant", "model": "assistant", "system": "system"}


def role_of(c):
    """Canonical role: user, assistant, system or unknown (also for null)."""
    t = F.lower(trim_blanks(c))
    out = F.lit("unknown")
    for written, role in ROLES.items():
        out = F.when(t == written, role).otherwise(out)
    return out


def messages(rows: DataFrame) -> DataFrame:
    """One row per message: ``key, seq, parent`` (null for a first message), ``role, session, has_text``."""
    return winners(
        rows,
        carry={
            "parent": key_of(F.col("parent_uuid")),
            "role": role_of(F.col("role")),
            "session": F.coalesce("session_id", F.lit("")),
            "has_text": F.coalesce(~F.col("content").rlike(rf"^{BLANKS}*\z"), F.lit(False)),
        },
    )


def conversations(rows: DataFrame) -> DataFrame:
    """The kept conversations, one row per message: ``root_uuid, turn_no, message_uuid, role, session, seq``.

    A conversation is kept if it starts at a message without parent, never branches, has only known roles and one
    session, has a user message with text, and each user message is directly followed by an assistant message with
    text. Orphans and cycles never lead back to a first message. Null and blank session ids count as equal. Repeated
    rows of a message count once (the earliest); an empty table gives no rows.
    """
    m = materialise(messages(rows), "messages")
    # What each parent needs to know of its children: hash-aggregated, so a parent of a third of all rows is no hot group.
    below = m.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(
        F.count("*").alias("n"), F.min(F.struct("role", "has_text", "session", "seq")).alias("next")
    )
    node = m.join(below, "key", "left").select(
        "key", "seq", "role", "session", "parent", "n",
        (
            (F.col("role") != "unknown")
            & (F.coalesce("n", F.lit(0)) <= 1)
            & (F.col("next").isNull() | (F.col("next.session") == F.col("session")))
            & ((F.col("role") != "user") | F.coalesce((F.col("next.role") == "assistant") & F.col("next.has_text"), F.lit(False)))
        ).alias("sound"),
        ((F.col("role") == "user") & F.col("has_text")).alias("asks"),
        F.when(F.col("n") == 1, F.col("next.seq")).alias("child"),
    )
    node = materialise(node, "nodes")
    # A message's pointer goes to its parent if that has no other child; the parent row itself says so.
    up = node.where("child IS NOT NULL").select(F.col("child").alias("seq"), F.col("seq").alias("ptr"))
    heads = node.where("parent IS NULL").select("seq")
    place = chain_positions(heads, up)
    full = materialise(node.join(place, "seq").select("head", "turn_no", "seq", "key", "role", "session", "sound", "asks"), "placed")
    good = full.groupBy("head").agg(F.min("sound").alias("sound"), F.max("asks").alias("asks")).where("sound AND asks").select("head")
    kept = full.join(good, "head", "left_semi")
    roots = kept.where("turn_no = 0").select("head", F.col("key").alias("root_uuid"))
    return kept.join(roots, "head").select("root_uuid", F.col("turn_no").cast("long").alias("turn_no"), F.col("key").alias("message_uuid"), "role", "session", "seq")


def chain_positions(heads: DataFrame, up: DataFrame) -> DataFrame:
    """Pointer jumping over disjoint chains.

    ``heads(seq)`` are the first elements, ``up(seq, ptr)`` points every other element at its predecessor; targets are
    unique. Returns ``seq, head, turn_no`` of everything that leads back to a head. Elements on cycles, and chains
    whose first element is no head, are left out.
    """
    done = [heads.select("seq", F.col("seq").alias("head"), F.lit(0).alias("turn_no"))]
    solved = done[0]
    open_ = materialise(up.join(heads, "seq", "left_anti").select("seq", "ptr", F.lit(1).alias("dist")), "jump")
    left = open_.count()
    while left:
        # Those whose pointer is solved finish; the others take over their target's pointer.
        to = solved.select(F.col("seq").alias("ptr"), "head", "turn_no")
        step = open_.join(to, "ptr", "left")
        hop = open_.select(F.col("seq").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("dist").alias("dist2"))
        step = materialise(
            step.join(hop, "ptr", "left").select(
                "seq", "head", (F.col("turn_no") + F.col("dist")).alias("turn_no"),
                F.col("ptr").alias("target"), F.col("turn_no").alias("target_no"),
                F.coalesce("ptr2", "ptr").alias("ptr"), (F.col("dist") + F.coalesce("dist2", F.lit(0))).alias("dist"),
                F.col("ptr2").isNotNull().alias("moved"),
            ),
            "jump",
        )
        new = step.where("head IS NOT NULL")
        done.append(new.select("seq", "head", "turn_no"))
        # Solved elements that nothing points at now will not be pointed at by the longer jumps to come.
        solved = done[-1].unionByName(new.select(F.col("target").alias("seq"), "head", F.col("target_no").alias("turn_no")))
        # Without a solved or an open target a pointer ends at an element that leads nowhere.
        open_ = step.where("head IS NULL AND moved").select("seq", "ptr", "dist")
        now = open_.count()
        if now == left:
            break
        left = now
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
