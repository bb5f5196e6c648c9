"""Usage ledger: rollups, repeats within five minutes, over-frequent functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_repeats(calls: DataFrame, keys: tuple[str, ...], ts: str = "ts", seconds: int = 300) -> DataFrame:
    """Adds ``repeat``: an earlier row of the same keys lies at most ``seconds`` back (equal times count by ``id``)."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    before = F.lag(at).over(W.partitionBy(*keys).orderBy(ts, "id"))
    return calls.withColumn("repeat", F.coalesce(at - before <= seconds * 1_000_000, F.lit(False)))


def rollup(calls: DataFrame, by: list[str]) -> DataFrame:
    """Calls, tokens, repeats and errors by the given columns."""
    return calls.groupBy(*by).agg(F.count("*").alias("calls"), F.round(F.coalesce(F.sum("tokens"), F.lit(0.0)), 4).alias("tokens"), F.count_if("repeat").alias("repeats"), F.count_if("error").alias("errors"))


def busiest(calls: DataFrame, fn: str, ts: str, minutes: int) -> DataFrame:
    """Per function the largest number of calls within any sliding range of ``minutes`` that ends at a call."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    n = F.count("*").over(W.partitionBy(fn).orderBy(at).rangeBetween(-minutes * 60_000_000, 0))
    return calls.withColumn("n", n).groupBy(fn).agg(F.max("n").alias(f"in_{minutes}_min"))


def over_frequency(calls: DataFrame, fn: str = "fn", ts: str = "ts", short: int = 10, long: int = 30) -> DataFrame:
    """Functions with more than ``short`` calls in some minute or more than ``long`` in some five minutes; one row each."""
    return busiest(calls, fn, ts, 1).join(busiest(calls, fn, ts, 5), fn).where((F.col("in_1_min") > short) | (F.col("in_5_min") > long))
