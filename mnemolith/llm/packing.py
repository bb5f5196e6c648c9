"""Problem 9: items into containers of fixed capacity, by multiway Karmarkar-Karp differencing.

Items larger than a container are cut: all but the last piece fill a container each. The other items are dealt by hash
to blocks of about ``windows`` containers. Within a block, differencing merges the two partial partitions with the
largest imbalance, the large sums of the one on the small sums of the other, until one near-equal partition is left.
The number of windows starts at the lower bound and rises where the capacity is exceeded.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolith.util import materialise


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Multiway Karmarkar-Karp: positions of ``sizes`` in ``k`` sets with near-equal sums.

    A partial partition keeps its non-empty sets by falling sum; the empty ones up to ``k`` are implied. Sets are
    binary trees of positions, so that merging costs nothing per item.
    """
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        over = len(a) + len(b) - k  # so many sets have to share a place
        if over <= 0:
            both = a + b
        else:
            # place i of a meets place k-1-i of b: the smallest of a get the largest of b
            both = a[: k - len(b)]
            for x, y in zip(a[k - len(b) :], reversed(b)):
                both.append((x[0] + y[0], (x[1], y[1])))
            both.extend(b[: k - len(a)])
        both.sort(key=lambda s: -s[0])
        spread = both[0][0] - (both[k - 1][0] if len(both) >= k else 0)
        tick += 1
        heapq.heappush(heap, (-spread, tick, both))
    out = []
    for _, tree in heap[0][2] if heap else []:
        items, todo = [], [tree]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo.extend(x)
            else:
                items.append(x)
        out.append(sorted(items))
    return out


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Positions by container; no sum exceeds ``capacity``, as no size does.

    Differencing at the lower bound of windows; a window above the capacity gives up the smallest item that brings it
    down to it. Given-up items go to the fullest window with room, and the window count rises for those without one.
    """
    if not sizes:
        return []
    k = max(-(-sum(sizes) // capacity), sum(2 * s > capacity for s in sizes), 1)
    sets = differencing(sizes, k)
    spare: list[int] = []
    for s in sets:
        over = sum(sizes[i] for i in s) - capacity
        while over > 0:
            out = min((i for i in s if sizes[i] >= over), key=lambda i: (sizes[i], i), default=None)
            if out is None:
                out = max(s, key=lambda i: (sizes[i], -i))
            s.remove(out)
            spare.append(out)
            over -= sizes[out]
    room = sorted((capacity - sum(sizes[i] for i in s), n) for n, s in enumerate(sets))
    for i in sorted(spare, key=lambda i: (-sizes[i], i)):
        at = bisect_left(room, (sizes[i], -1))
        if at == len(room):
            sets.append([i])
            insort(room, (capacity - sizes[i], len(sets) - 1))
        else:
            left, n = room.pop(at)
            sets[n].append(i)
            insort(room, (left - sizes[i], n))
    return [s for s in sets if s]


def pack_documents(sizes: DataFrame, capacities: dict[str, int], windows: int = 256, most_items: int = 20_000) -> DataFrame:
    """``pack_kind, container, doc_id, piece, start, tokens``: where each part of each document goes.

    ``sizes`` has ``doc_id, tokens``; null sizes and those of 0 or less are left out. Repeated rows are items of their
    own; a null id is an id like any other. A container is named by its block and window, or by its own number if one
    piece of a large item fills it. ``capacities`` are positive; kinds without a capacity get nothing. A block holds
    about ``windows`` containers and at most about ``most_items`` items, so no task grows with the data.
    """
    spark = sizes.sparkSession
    idtype = dict(sizes.dtypes)["doc_id"]
    schema = f"pack_kind string, container string, doc_id {idtype}, piece int, start long, tokens long"
    capacities = {k: c for k, c in capacities.items() if c and c > 0}
    if not capacities:
        return spark.createDataFrame([], schema)
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("pack_kind"), F.lit(c).cast("long").alias("capacity")) for k, c in sorted(capacities.items())]))
    items = sizes.where("tokens > 0").select("doc_id", F.col("tokens").cast("long").alias("size"), F.monotonically_increasing_id().alias("row"))
    items = materialise(items.select("doc_id", "size", "row", kinds.alias("k")).select("doc_id", "size", "row", "k.*"), "items")
    whole = F.floor((F.col("size") - 1) / F.col("capacity")).cast("int")  # full pieces before the last one
    full = items.where("size > capacity").select("pack_kind", "doc_id", "row", "capacity", F.posexplode(F.array_repeat(F.lit(0), whole)).alias("piece", "z"))
    full = full.select("pack_kind", F.concat(F.lit("full-"), "row", F.lit("-"), "piece").alias("container"), "doc_id", "piece", (F.col("piece") * F.col("capacity")).alias("start"), F.col("capacity").alias("tokens"))
    last = items.select("pack_kind", "capacity", "doc_id", "row", whole.alias("piece"), (whole * F.col("capacity")).alias("start"), (F.col("size") - whole * F.col("capacity")).alias("tokens"))
    load = {r.pack_kind: max(-(-r.s // (capacities[r.pack_kind] * windows)), -(-r.n // most_items)) for r in last.groupBy("pack_kind").agg(F.sum("tokens").alias("s"), F.count("*").alias("n")).collect()}
    if not load:
        return spark.createDataFrame([], schema)
    blocks = F.lit(1).cast("long")
    for k, n in load.items():
        blocks = F.when(F.col("pack_kind") == k, F.lit(int(n))).otherwise(blocks)
    dealt = last.withColumn("block", F.pmod(F.xxhash64("row", "pack_kind"), blocks))

    def one(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row", ignore_index=True)
        names = [""] * len(rows)
        for w, s in enumerate(pack(rows.tokens.tolist(), int(rows.capacity.iloc[0]))):
            for i in s:
                names[i] = f"{keys[1]}-{w}"
        rows["container"] = names
        return rows[["pack_kind", "container", "doc_id", "piece", "start", "tokens"]]

    packed = dealt.groupBy("pack_kind", "block").applyInPandas(one, schema)
    return full.select("pack_kind", "container", "doc_id", "piece", F.col("start").cast("long").alias("start"), "tokens").unionByName(packed)


def fill(packed: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """Per kind: containers, tokens, the lower bound of containers and the share of space in use."""
    cap = F.lit(None).cast("long")
    for k, c in capacities.items():
        cap = F.when(F.col("pack_kind") == k, F.lit(int(c))).otherwise(cap)
    per = packed.groupBy("pack_kind", "container").agg(F.sum("tokens").alias("used"))
    return per.groupBy("pack_kind").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest")).select("pack_kind", "containers", "tokens", F.ceil(F.col("tokens") / cap).alias("at_least"), "fullest", F.round(F.col("tokens") / (F.col("containers") * cap), 6).alias("used_share"))
