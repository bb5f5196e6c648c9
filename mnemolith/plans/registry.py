"""Extension surface: processors, components and sources by name; model calls as a pluggable stage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

from mnemolith.functions.jsonx import string_array
from mnemolith.operators.ingest import CONSUMERS, is_pending


class Processor(Protocol):
    """Takes the records it has not seen and returns records and marks."""

    name: str
    consumer: str

    def process(self, records: DataFrame) -> DataFrame: ...


class Registry:
    """Names are unique; a second registration is an error."""

    def __init__(self) -> None:
        self.processors: dict[str, Processor] = {}
        self.components: dict[str, Callable[..., DataFrame]] = {}

    def add_processor(self, p: Processor) -> None:
        if p.name in self.processors:
            raise ValueError(f"processor {p.name!r} is registered already")
        if p.consumer not in CONSUMERS:
            raise ValueError(f"unknown consumer {p.consumer!r}")
        self.processors[p.name] = p

    def add_component(self, name: str, provider: Callable[..., DataFrame]) -> None:
        if name in self.components:
            raise ValueError(f"component {name!r} is registered already")
        self.components[name] = provider

    def run(self, name: str, records: DataFrame) -> DataFrame:
        """The processor's output for the records its consumer has not seen."""
        from pyspark.sql import functions as F

        p = self.processors[name]
        return p.process(records.where(is_pending(F.col("consumed_mask"), p.consumer)))


def stub_model(prompt: str) -> str:
    """Deterministic stand-in for a model: the distinct longer words of the prompt as a JSON array."""
    import json
    import re

    return json.dumps(list(dict.fromkeys(re.findall(r"[a-z]{6,}", prompt.lower())))[:5])


def model_stage(records: DataFrame, call: Callable[[str], str] = stub_model, batch: int = 10) -> DataFrame:
    """``id, labels`` by one model call per record text, in Arrow batches; unreadable answers give no labels."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for i in range(0, len(p), batch):
                q = p.iloc[i : i + batch]
                yield pd.DataFrame({"id": q["id"], "labels": [string_array(call(c or "")) for c in q["content"]]})

    return records.select("id", "content").mapInPandas(run, f"id {dict(records.dtypes)['id']}, labels array<string>")
