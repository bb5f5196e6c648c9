"""Versions and duplicates of records."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolith.functions import text as T
from mnemolith.util import materialise


class _Later:
    """Records of one key in order of time, with the postings of their terms."""

    def __init__(self, rows: pa.Table):
        self.n, self.ids, self.times = len(rows), _one(rows["id"]), _one(rows["created_at"])
        self.at = _micros(rows["created_at"])
        ts = _one(rows["ts"])
        coded = ts.flatten().dictionary_encode()
        self.words, self.codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        self.sizes = pc.list_value_length(ts).to_numpy()
        self.keys = np.sort(self.codes * self.n + np.repeat(np.arange(self.n), self.sizes))

    def own(self) -> Iterator[np.ndarray]:
        """Codes of the terms of each of these records."""
        return iter(np.split(self.codes, np.cumsum(self.sizes)[:-1]))

    def of(self, ts: pa.Array) -> Iterator[np.ndarray]:
        """Codes of the terms of other records; terms that none of these records has are left out."""
        codes = pc.fill_null(pc.index_in(ts.flatten(), value_set=self.words), -1).to_numpy().astype(np.int64)
        return (c[c >= 0] for c in np.split(codes, np.cumsum(pc.list_value_length(ts).to_numpy())[:-1]))

    def first(self, codes: np.ndarray, at: int, shared: int) -> int | None:
        """Place of the first record after ``at`` with ``shared`` of the terms; looks in growing steps, to the last one."""
        lo, width = int(np.searchsorted(self.at, at, "right")), 256
        while lo < self.n and len(codes) >= shared:
            hi = min(self.n, lo + width)
            start = np.searchsorted(self.keys, codes * self.n + lo)
            n = np.searchsorted(self.keys, codes * self.n + hi) - start
            keys = self.keys[np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())]
            hits = np.flatnonzero(np.bincount(keys % self.n - lo, minlength=1) >= shared)
            if len(hits):
                return lo + int(hits[0])
            lo, width = hi, width * 8
        return None


def _one(c: pa.ChunkedArray) -> pa.Array:
    c = c.combine_chunks()
    return pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c


def _micros(c: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return pc.cast(c, pa.int64()).to_numpy()


def _first_later(rows: DataFrame, shared: int) -> DataFrame:
    """``id, g, part, created_at, ts, new, new_at``: the first later record of the same ``g`` and ``part``.

    Rows whose ``query`` is null are compared with one another; rows with true with those with false. Where there is no
    such record, ``new`` is null, and only there ``ts`` is kept. One key's rows are in memory, but those with true pass by.
    """

    def answer(later: _Later, asked: pa.Table, codes: Iterator[np.ndarray]) -> pa.RecordBatch:
        at = [later.first(c, t, shared) for c, t in zip(codes, _micros(asked["created_at"]).tolist())]
        to, rest = pa.array(at, pa.int64()), pa.array([i if x is None else None for i, x in enumerate(at)], pa.int64())
        out = [_one(asked[c]) for c in ("id", "g", "part", "created_at")] + [_one(asked["ts"]).take(rest), later.ids.take(to), later.times.take(to)]
        return pa.RecordBatch.from_arrays(out, ["id", "g", "part", "created_at", "ts", "new", "new_at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, later = None, [], None

        def close():
            if held and held[0]["query"][0].as_py() is None:
                rows = pa.Table.from_batches(held)
                mine = _Later(rows)
                yield answer(mine, rows, mine.own())

        for batch in batches:
            at = 0
            for (g, part, query), same in groupby(zip(*(batch[c].to_pylist() for c in ("g", "part", "query")))):
                piece = batch.slice(at, n := sum(1 for _ in same))
                at += n
                if key != (g, part):
                    yield from close()
                    key, held, later = (g, part), [], None
                if not query:
                    held.append(piece)
                elif held:
                    later = later or _Later(pa.Table.from_batches(held))
                    yield answer(later, pa.Table.from_batches([piece]), later.of(piece["ts"]))
        yield from close()

    kind = dict(rows.dtypes)
    rows = rows.select("g", "part", "query", "created_at", "id", "ts").sortWithinPartitions("g", "part", "query", "created_at", "id")
    return rows.mapInArrow(run, f"id {kind['id']}, g string, part int, created_at {kind['created_at']}, ts array<string>, new {kind['id']}, new_at {kind['created_at']}")


def superseded(records: DataFrame, shared: int = 3, keys: tuple[str, ...] = ("phase", "category", "project"), block: int = 24 << 20) -> DataFrame:
    """``id, superseded_by``: the first later record with the same keys that shares at least ``shared`` terms.

    Only a record's first successor is looked for, in order of time over the terms' postings, so no pairs are written.
    The records of a key are compared in one task. Keys with more than ``block`` bytes of text are cut by time into parts
    of about that size: a record without a successor in its own part is sent to all later parts of the key. Records with
    fewer terms than ``shared``, or in the inbox, neither supersede nor are superseded. Null keys count as ''.
    """
    g = F.concat_ws("\x01", *[F.coalesce(F.col(k), F.lit("")) for k in keys])
    r = records.where("phase <> 'inbox' AND created_at IS NOT NULL").select("id", "created_at", g.alias("g"), "content")
    ts, alone = T.terms(F.col("content")).alias("ts"), F.lit(None).cast("boolean").alias("query")
    size = r.groupBy("g").agg(F.sum(F.coalesce(F.octet_length("content"), F.lit(0))).alias("bytes"))
    large = materialise(size.where(F.col("bytes") > block), "large")  # one row per `block` bytes at most
    total = large.agg(F.sum("bytes")).head()[0]
    small = r.join(F.broadcast(large), "g", "left_anti") if total else r
    got = _first_later(small.repartition("g").select("id", "created_at", "g", F.lit(0).alias("part"), alone, ts), shared)
    if total:
        parts = -(-total // block)
        hot = r.join(F.broadcast(large), "g", "left_semi").repartitionByRange(parts, "g", "created_at", "id")
        hot = materialise(hot.withColumn("part", F.spark_partition_id()), "parts")
        own = _first_later(hot.repartition(parts, "g", "part").select("id", "created_at", "g", "part", alone, ts), shared)
        own = materialise(own, "own")
        later = F.broadcast(hot.select("g", F.col("part").alias("to")).distinct())
        rest = own.where(F.col("new").isNull() & (F.size("ts") >= shared)).join(later, "g").where("to > part")
        rest = rest.select("id", "created_at", "g", F.col("to").alias("part"), F.lit(True).alias("query"), "ts")
        both = hot.select("id", "created_at", "g", "part", F.lit(False).alias("query"), ts).unionByName(rest)
        got = got.unionByName(own).unionByName(_first_later(both.repartition(parts, "g", "part"), shared))
    return got.where("new IS NOT NULL").groupBy("id").agg(F.min_by("new", F.struct("new_at", "new")).alias("superseded_by"))


def is_superseded(meta: Column) -> Column:
    """Whether the metadata say that a newer record has taken the place of this one."""
    return (F.coalesce(F.get_json_object(meta, "$.superseded_by"), F.lit("")) != "") | (F.coalesce(F.get_json_object(meta, "$.superseded"), F.lit("")) == "true")


def unique_by_fingerprint(records: DataFrame) -> DataFrame:
    """The newest record of each content fingerprint; null contents are left out."""
    fp = T.fingerprint(F.col("content"))
    return records.withColumn("fp", fp).where("fp IS NOT NULL").groupBy("fp").agg(F.min_by("id", F.struct(F.col("created_at").isNull(), -F.unix_micros(F.col("created_at").cast("timestamp")), "id")).alias("id"), F.count("*").alias("n"))
