"""Tolerant reading of JSON that a model wrapped in prose or code fences."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_json(text: str | None):
    """The first JSON array or object that can be read, also without a trailing comma; None if there is none."""
    if not text:
        return None
    decoder = json.JSONDecoder()
    for t in (text, re.sub(r",\s*([\]}])", r"\1", text)):
        for m in re.finditer(r"[\[{]", t):
            try:
                return decoder.raw_decode(t, m.start())[0]
            except ValueError:
                continue
    return None


def string_array(text: str | None) -> list[str]:
    """Non-blank strings of the first JSON array."""
    got = first_json(text)
    return [x.strip() for x in got if isinstance(x, str) and x.strip()] if isinstance(got, list) else []


def merge_patch(base: Column, patch: Column) -> Column:
    """Shallow merge of two JSON objects; the patch wins. A null or unreadable side counts as empty."""
    read = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.to_json(F.map_zip_with(read(base), read(patch), lambda k, a, b: F.coalesce(b, a)))


def field(meta: Column, name: str) -> Column:
    """A text field of a JSON object; blank becomes null."""
    return F.nullif(F.trim(F.get_json_object(meta, f"$.{name}")), F.lit(""))
