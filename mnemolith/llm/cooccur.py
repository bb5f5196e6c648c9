"""Problem 1: items that appear together more often than chance.

Items are de-duplicated per basket, ordered pairs are emitted and counted with map-side combining, and lift and
pointwise mutual information follow from the marginals. Only items that can still be part of a result are paired.

Baskets above ``large`` items are not expanded into pairs. There can be at most rows/large of them, so each item's
list of large baskets is short; pairs meet there by a prefix filter: a pair that shares c large baskets shares one
outside the (c-1) largest of either item, whatever the size of the baskets. Both parts are added exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolith.util import materialise


def co_occurrence(mentions: DataFrame, item: str = "entity_id", basket: str = "memory_id", min_count: int = 5, min_lift: float = 4.0, large: int = 1000) -> DataFrame:
    """Pairs with ``c >= min_count`` and ``c*n >= min_lift*a*b``: ``item_a < item_b, c, a, b, n, lift, pmi``.

    ``n`` counts all baskets, ``a`` and ``b`` those with the item, ``c`` those with both. Rows with a null item or
    basket take no part, repeated rows count once, an empty table gives no rows. ``min_count`` is at least 1 and
    ``min_lift`` at least 0. Extra columns are ignored.
    """
    rows = mentions.where(F.col(item).isNotNull() & F.col(basket).isNotNull()).select(F.col(item).alias("i"), F.col(basket).alias("m")).distinct()
    rows = materialise(rows, "mentions")
    n = rows.agg(F.count_distinct("m")).head()[0]
    # c <= min(a, b), so c*n >= min_lift*a*b needs max(a, b) <= n/min_lift.
    marginal = materialise(rows.groupBy("i").agg(F.count("*").alias("a")).where((F.col("a") >= min_count) & (F.col("a") * min_lift <= n)), "marginals")
    live = rows.join(marginal.select("i"), "i", "left_semi")
    size = live.groupBy("m").agg(F.count("*").alias("k"))
    live = materialise(live.join(size.where("k > 1"), "m"), "live")
    small = live.where(F.col("k") <= large)
    pairs = small.select("m", F.col("i").alias("item_a")).join(small.select("m", F.col("i").alias("item_b")), "m").where("item_a < item_b")
    counted = pairs.groupBy("item_a", "item_b").agg(F.count("*").alias("c"))
    if not live.where(F.col("k") > large).isEmpty():
        counted = _with_large(counted, live.where(F.col("k") > large), min_count)
    both = counted.where(F.col("c") >= min_count)
    both = both.join(marginal.select(F.col("i").alias("item_a"), "a"), "item_a").join(marginal.select(F.col("i").alias("item_b"), F.col("a").alias("b")), "item_b")
    lift = F.col("c").cast("double") * F.lit(n) / (F.col("a").cast("double") * F.col("b"))
    found = both.where(F.col("c") * F.lit(n) >= F.lit(min_lift) * F.col("a") * F.col("b"))
    return found.select("item_a", "item_b", "c", "a", "b", F.lit(n).cast("long").alias("n"), lift.alias("lift"), F.log2(lift).alias("pmi"))


def _with_large(counted: DataFrame, big: DataFrame, min_count: int) -> DataFrame:
    """Add the baskets that were too large to expand to the counts of pairs."""
    counted = materialise(counted, "pairs")
    lists = materialise(big.groupBy("i").agg(F.array_sort(F.collect_set(F.struct(F.col("k"), "m"))).alias("big")), "large")
    side = lambda x: lists.select(F.col("i").alias(f"item_{x}"), F.col("big").alias(f"big_{x}"))
    shared = F.coalesce(F.size(F.array_intersect("big_a", "big_b")), F.lit(0))
    # Pairs known from small baskets.
    known = counted.join(side("a"), "item_a", "left").join(side("b"), "item_b", "left").select("item_a", "item_b", (F.col("c") + F.when(F.col("big_a").isNotNull() & F.col("big_b").isNotNull(), shared).otherwise(0)).alias("c"))
    # Pairs that meet in large baskets only: at least min_count of them, so one lies before the last min_count - 1.
    head = lists.where(F.size("big") >= min_count).select("i", "big", F.explode(F.slice("big", F.lit(1), F.size("big") - (min_count - 1))).alias("at"))
    a = head.select(F.col("i").alias("item_a"), F.col("big").alias("big_a"), "at")
    b = head.select(F.col("i").alias("item_b"), F.col("big").alias("big_b"), "at")
    meet = a.join(b, "at").where("item_a < item_b").select("item_a", "item_b", shared.cast("long").alias("c")).distinct()
    only = meet.where(F.col("c") >= min_count).join(counted, ["item_a", "item_b"], "left_anti")
    return known.unionByName(only)
