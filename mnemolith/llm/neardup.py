"""Problem 2: edited versions of one another, by BK-trees over Hamming distance. Exact.

A text is the set of its ordered pairs of neighbouring words. Two sets A, B have a Jaccard similarity of at least t
exactly if their Hamming distance |A xor B| is at most (1-t)/(1+t) * (|A|+|B|). A 384-bit fingerprint holds the parity
of the members hashed to each bit, so the Hamming distance of two fingerprints never exceeds that of the sets: a
BK-tree over fingerprints, searched within that radius, loses nothing, and an exact comparison of the sets follows.

Trees are sharded by shared rare members. With the members of all sets in one global order, rare ones first, two
similar sets share a member within the first third of the smaller and the first half of the larger set (for t = 0.5);
so a shard is one member, its tree holds the sets that have it in their index prefix, and the sets that have it in
their probe prefix query it. The order comes from a count sketch of fixed size: its errors change the order of
members, hence only the work. A member so frequent that its shard would be unbounded is salted: its tree is split over
several shards and the queries go to all of them.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolith.llm.copies import field_form, plain_form
from mnemolith.util import materialise, spread

WORD = re.compile(r"[^\W_]+")
SKETCH_BITS = 21
SIGNATURE_BITS = 384
PER_TASK = 20_000
POSTING = np.dtype([("t", "<u8"), ("p", "<u4")])
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * M2
    return x ^ (x >> np.uint64(29))


class _Words(dict):
    """64-bit hash of a word, remembered per worker up to a bound."""

    def __missing__(self, w: str) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[w] = int.from_bytes(blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return h


_words = _Words()


def word_pairs(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(row number, hash) of the distinct word pairs of each text, sorted; null and one-word texts have none."""
    flat: list[int] = []
    lens = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if t:
            w = WORD.findall(t.lower())
            lens[i] = len(w)
            flat.extend(map(_words.__getitem__, w))
    h = np.array(flat, np.uint64)
    if len(h) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(texts)), lens)
    same = row[1:] == row[:-1]
    row, pair = row[1:][same], _mix(h[:-1] * M1 + (h[1:] ^ (h[1:] >> np.uint64(17))))[same]
    order = np.lexsort((pair, row))
    row, pair = row[order], pair[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (pair[1:] != pair[:-1])
    return row[new], pair[new]


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 2_000) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows, so that the arrays over a batch's words stay small."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def set_keys(n_rows: int, row: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit key of each row's set and the set's size."""
    key = np.zeros(n_rows, np.uint64)
    size = np.bincount(row, minlength=n_rows) if len(row) else np.zeros(n_rows, np.int64)
    if len(row):
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        key[row[starts]] = np.add.reduceat(_mix(pair ^ M1), starts)
    return key.view(np.int64), size


READ = "id string, plain binary, fields binary, key long, size int, block int, z binary"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One reading of all texts: a row with ``key`` and ``size`` for each, then the task's part of the sketch.

    The sketch goes out as compressed counters, one row (without id) for each of 64 blocks that has any.
    """
    total = np.zeros(1 << SKETCH_BITS, np.int32)
    names = ["id", "plain", "fields", "key", "size", "block", "z"]
    for b in _slices(batches):
        texts = b.column("content").to_pylist()
        row, pair = word_pairs(texts)
        key, size = set_keys(len(texts), row, pair)
        np.add.at(total, (pair >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
        n = len(texts)
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("plain"), b.column("fields"), pa.array(key), pa.array(size.astype(np.int32)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
    blocks = [(i, zlib.compress(x.tobytes(), 1)) for i, x in enumerate(np.split(total, 64)) if x.any()]
    n = len(blocks)
    none = [pa.nulls(n, pa.string()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())]
    yield pa.RecordBatch.from_arrays([*none, pa.array([i for i, _ in blocks], pa.int32()), pa.array([z for _, z in blocks], pa.binary())], names)


def _sum_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for i, z in zip(b.column("block").to_pylist(), b.column("z").to_pylist()):
            x = np.frombuffer(zlib.decompress(z), np.int32)
            total[i] = total[i] + x if i in total else x
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in total.values()], pa.binary())], ["block", "z"])


def sketch(parts: DataFrame) -> np.ndarray:
    """Counters of fixed number (2**SKETCH_BITS) for how many texts have the members hashed to each; never too low."""
    rows = parts.select("block", "z").where("block IS NOT NULL").repartition(8, "block").mapInArrow(_sum_counts, "block int, z binary").collect()
    out = np.zeros((64, (1 << SKETCH_BITS) // 64), np.int32)
    for r in rows:
        out[r.block] = np.frombuffer(zlib.decompress(r.z), np.int32)
    return out.ravel()


def _postings(counts, shards: int, t: float, hot: int):
    """Per text and shard one row with the text's key, size, fingerprint and its prefix members in that shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = counts.value
        seen: set[int] = set()
        for b in _slices(batches):
            texts = b.column(0).to_pylist()
            row, pair = word_pairs(texts)
            if not len(row):
                continue
            key, size = set_keys(len(texts), row, pair)
            fresh = np.zeros(len(texts), bool)  # equal sets go out once a task: a group of copies is no hot shard
            for i in np.flatnonzero(size):
                k = int(key[i])
                if k not in seen:
                    seen.add(k)
                    fresh[i] = True
            if len(seen) > 5_000_000:
                seen.clear()
            on = fresh[row]
            row, pair = row[on], pair[on]
            if not len(row):
                continue
            bits = np.bincount(row * SIGNATURE_BITS + (pair % np.uint64(SIGNATURE_BITS)).astype(np.int64), minlength=len(texts) * SIGNATURE_BITS)
            sig = np.packbits((bits & 1).astype(np.uint8).reshape(len(texts), SIGNATURE_BITS), axis=1)
            often = df[(pair >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
            order = np.lexsort((pair, often, row))
            row, pair, often = row[order], pair[order], often[order]
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            pos = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
            n = size[row]
            rest = n - pos  # members from here on, at most so many can be shared
            least = np.ceil(t * n - 1e-9)  # no similar set is smaller
            keep = (rest * (1 + t) >= t * (n + least) - 1e-9) & (often > 1)
            row, pair, often, pos, n, rest = (x[keep] for x in (row, pair, often, pos, n, rest))
            salts = -(-often // hot)
            salted = salts > 1
            index = rest * (1 + t) >= 2 * t * n - 1e-9
            shard = ((pair >> np.uint64(11)) % np.uint64(shards)).astype(np.int64)
            post = np.empty(len(row), POSTING)
            post["t"], post["p"] = pair, pos
            if salted.any():
                # Index entries go to one salt, queries to every salt of the member.
                rows, posts, shs = [row[~salted]], [post[~salted]], [shard[~salted]]
                for i in np.flatnonzero(salted):
                    own = int(key[row[i]]) % int(salts[i])
                    for s in range(int(salts[i])):
                        p = post[i].copy()
                        p["t"] = int(_mix(np.array([pair[i]], np.uint64) + np.uint64(s))[0])
                        if not (index[i] and s == own):
                            p["p"] |= 1 << 31
                        rows.append(row[i : i + 1])
                        posts.append(np.array([p], POSTING))
                        shs.append(np.array([(int(p["t"]) >> 11) % shards]))
                row, post, shard = np.concatenate(rows), np.concatenate(posts), np.concatenate(shs)
            order = np.lexsort((shard, row))
            row, post, shard = row[order], post[order], shard[order]
            if not len(row):
                continue
            start = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (shard[1:] != shard[:-1])])
            at = row[start]
            offsets = (np.r_[start, len(row)] * POSTING.itemsize).astype(np.int32)
            toks = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(post.tobytes())])
            width = SIGNATURE_BITS // 8
            sigs = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer((np.arange(len(start) + 1) * width).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(sig[at]).tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(shard[start].astype(np.int32)), pa.array(key[at]), pa.array(size[at].astype(np.int32)), sigs, toks], ["shard", "key", "size", "sig", "posts"])

    return run


class BKTree:
    """Children are keyed by their Hamming distance to the parent; a search follows the edges within the radius.

    A leaf keeps up to ``LEAF`` entries in a list and becomes a parent of its first entry when it overflows, so that
    small trees are one list.
    """

    LEAF = 24
    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root: list = [[], None]  # entries (fingerprint, item); children by distance to the first entry

    def add(self, sig: int, item) -> None:
        node = self.root
        while node[1] is not None:
            d = (node[0][0][0] ^ sig).bit_count()
            child = node[1].get(d)
            if child is None:
                node[1][d] = [[(sig, item)], None]
                return
            node = child
        node[0].append((sig, item))
        if len(node[0]) > self.LEAF:
            pivot = node[0][0][0]
            by: dict[int, list] = {}
            for x in node[0][1:]:
                by.setdefault((pivot ^ x[0]).bit_count(), []).append(x)
            if len(by) > 1:  # equal fingerprints stay one list
                node[0], node[1] = node[0][:1], {d: [xs, None] for d, xs in by.items()}

    def search(self, sig: int, radius: int) -> list:
        """Entries within ``radius`` of the fingerprint."""
        out: list = []
        todo = [self.root]
        while todo:
            entries, children = todo.pop()
            if children is None:
                out += [x for x in entries if (x[0] ^ sig).bit_count() <= radius]
                continue
            d = (entries[0][0] ^ sig).bit_count()
            if d <= radius:
                out.append(entries[0])
            lo, hi = d - radius, d + radius
            todo += [c for e, c in children.items() if lo <= e <= hi]
        return out


def _search_shards(t: float):
    """Candidate pairs of set keys of all members in this task's shards, each pair once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sizes, sigs, posts, counts = [], [], [], [], []
        for b in batches:
            if not b.num_rows:
                continue
            keys.append(b.column("key").to_numpy())
            sizes.append(b.column("size").to_numpy())
            sigs.extend(b.column("sig").to_pylist())
            p = b.column("posts").to_pylist()
            counts.append(np.array([len(x) // POSTING.itemsize for x in p]))
            posts.append(np.frombuffer(b"".join(p), POSTING))
        if not keys:
            return
        key, size = np.concatenate(keys), np.concatenate(sizes)
        post = np.concatenate(posts)
        doc = np.repeat(np.arange(len(key)), np.concatenate(counts))
        del posts, keys, sizes, counts
        order = np.lexsort((size[doc], post["t"]))
        tok, at = post["t"][order], doc[order]
        pos = post["p"][order]
        start = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]])
        end = np.r_[start[1:], len(tok)]
        some = end - start > 1
        found: set[tuple[int, int]] = set()
        factor = (1 - t) / (1 + t)
        key_l, size_l, at_l, pos_l = key.tolist(), size.tolist(), at.tolist(), pos.tolist()
        sigs = [int.from_bytes(x, "little") for x in sigs]
        for s, e in zip(start[some].tolist(), end[some].tolist()):
            tree = BKTree()
            seen = set()
            for i in range(s, e):  # by growing size: the tree holds the smaller partners
                x = at_l[i]
                k = key_l[x]
                if k in seen:
                    continue
                seen.add(k)
                n, p = size_l[x], pos_l[i]
                asks_only = p >> 31
                rest = n - (p & 0x7FFFFFFF)
                sig = sigs[x]
                for sig2, (k2, n2, rest2) in tree.search(sig, int(factor * 2 * n + 1e-9)):
                    both = n + n2
                    if n2 >= t * n - 1e-9 and min(rest, rest2) * (1 + t) >= t * both - 1e-9 and (sig ^ sig2).bit_count() <= factor * both + 1e-9:
                        found.add((k, k2) if k < k2 else (k2, k))
                if not asks_only and rest * (1 + t) >= 2 * t * n - 1e-9:
                    tree.add(sig, (k, n, rest))
        if found:
            a, b = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["key_a", "key_b"])

    return run


def _verify(t: float):
    """Exact similarity of the two texts of each candidate."""

    def pairs_of(text: str, memo: dict) -> frozenset:
        if text not in memo:
            if len(memo) > 2000:
                memo.clear()
            w = WORD.findall(text.lower())
            memo[text] = frozenset(zip(w, w[1:]))
        return memo[text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, frozenset] = {}
        for b in batches:
            keep = []
            for x, y in zip(b.column("text_a").to_pylist(), b.column("text_b").to_pylist()):
                s, u = pairs_of(x, memo), pairs_of(y, memo)
                both = len(s & u)
                keep.append(both >= t * (len(s) + len(u) - both) - 1e-9)
            yield b.select(["key_a", "key_b"]).filter(pa.array(keep, pa.bool_()))

    return run


def similar_sets(memories: DataFrame, docs: DataFrame, t: float = 0.5, hot: int = 20_000, shards: int | None = None) -> DataFrame:
    """Pairs ``key_a < key_b`` of different sets with a Jaccard similarity of at least ``t``.

    ``memories`` has ``id, content``, ``docs`` the ``id, key, size`` of the same rows and the parts of the sketch.
    """
    spark = memories.sparkSession
    # A task holds its shards' postings in memory: about PER_TASK texts' worth of them, however many texts there are.
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // PER_TASK))
    texts = spread(memories.select("content").where("content IS NOT NULL"))
    counts = spark.sparkContext.broadcast(sketch(docs))  # 2**SKETCH_BITS counters, however many texts
    posts = texts.mapInArrow(_postings(counts, shards, t, hot), "shard int, key long, size int, sig binary, posts binary")
    cands = posts.repartitionById(shards, F.col("shard")).mapInArrow(_search_shards(t), "key_a long, key_b long").distinct()
    cands = materialise(cands, "candidates")
    wanted = cands.select(F.explode(F.array("key_a", "key_b")).alias("key")).distinct()
    one = docs.where("size > 0").groupBy("key").agg(F.min("id").alias("id")).join(wanted, "key", "left_semi")
    text = materialise(memories.select("id", "content").join(one, "id").select("key", F.col("content").alias("text")), "texts")
    with_a = cands.join(text.select(F.col("key").alias("key_a"), F.col("text").alias("text_a")), "key_a")
    with_b = with_a.join(text.select(F.col("key").alias("key_b"), F.col("text").alias("text_b")), "key_b")
    return with_b.select("key_a", "key_b", "text_a", "text_b").mapInArrow(_verify(t), "key_a long, key_b long")


def near_duplicates(memories: DataFrame, t: float = 0.5, **how) -> DataFrame:
    """Pairs ``memory_a < memory_b`` whose word-pair sets, not both empty, have a similarity of at least ``t`` and
    that are no copies in the sense of problem 5.

    Null contents, and texts with fewer than two words, have an empty set and no partner. Ids must be unique; copies
    are compared once, as one class, and expanded at the end.
    """
    docs = spread(memories.select("id", "content").where("content IS NOT NULL")).select("id", "content", F.unhex(F.md5(plain_form(F.col("content")))).alias("plain"), F.unhex(F.md5(F.nullif(field_form(F.col("content")), F.lit("")))).alias("fields"))
    docs = materialise(docs.mapInArrow(_read, READ), "docs")
    pairs = materialise(similar_sets(memories.select("id", "content"), docs, t, **how), "pairs")
    # Classes of copies: members of a class are never partners of one another, so no group of copies is squared.
    some = docs.where("size > 0")
    klass = some.groupBy("key", "plain", "fields").agg(F.count("*").alias("n"))
    side = lambda x: klass.select(F.col("key").alias(f"key_{x}"), F.col("plain").alias(f"plain_{x}"), F.col("fields").alias(f"fields_{x}"))
    across = pairs.join(side("a"), "key_a").join(side("b"), "key_b")
    several = klass.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    multi = klass.join(several, "key", "left_semi")
    m = lambda x: multi.select(F.col("key"), F.col("plain").alias(f"plain_{x}"), F.col("fields").alias(f"fields_{x}"))
    within = m("a").join(m("b"), "key").where("struct(plain_a, fields_a) < struct(plain_b, fields_b)").select(F.col("key").alias("key_a"), F.col("key").alias("key_b"), "plain_a", "plain_b", "fields_a", "fields_b")
    linked = across.unionByName(within).where("plain_a <> plain_b AND NOT coalesce(fields_a = fields_b, false)")
    member = lambda x: some.select(F.col("id").alias(f"id_{x}"), F.col("key").alias(f"key_{x}"), F.col("plain").alias(f"plain_{x}"), F.coalesce("fields", F.lit(b"")).alias(f"fields_{x}"))
    linked = linked.withColumns({c: F.coalesce(c, F.lit(b"")) for c in ("fields_a", "fields_b")})
    full = linked.join(member("a"), ["key_a", "plain_a", "fields_a"]).join(member("b"), ["key_b", "plain_b", "fields_b"])
    return full.select(F.least("id_a", "id_b").alias("memory_a"), F.greatest("id_a", "id_b").alias("memory_b")).distinct()
