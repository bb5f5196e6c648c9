"""Problem 8: token ids of every text by a public byte-level BPE vocabulary, by prefix-sharing trie traversal.

Byte-pair encoding has a property that lets a word be encoded prefix by prefix: the encoding of a prefix ends in
exactly one token, and what comes before that token is the encoding of a shorter prefix. The distinct words of a batch
are visited in the depth-first order of their trie; the state of each trie node is the last token of that prefix, so a
prefix shared by many words is treated once. A token can follow another exactly if merging the two never prefers a
merge across their border.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from mnemolith.util import spread

#: Where the vocabulary files of the public tokenizers are.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
#: The published splitting pattern of this vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class TrieEncoder:
    """Encoder for one ``.tiktoken`` rank file; remembers the encodings of words up to a bound."""

    def __init__(self, path: str, remember: int = 400_000) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.text = {r: t for t, r in self.ranks.items()}
        self.remember = remember
        self.words: dict[str, bytes] = {}
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.fits: dict[int, bool] = {}
        self.pattern = regex.compile(PATTERN)
        # Tokens by reversed bytes: walking back from a position meets every token that ends there.
        self.ends: dict = {}
        for t, r in self.ranks.items():
            node = self.ends
            for byte in reversed(t):
                node = node.setdefault(byte, {})
            node[-1] = r

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one; None for a single byte."""
        if token not in self.parts:
            t = self.text[token]
            parts = [t[i : i + 1] for i in range(len(t))]
            while len(parts) > 2:
                best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
                if self.ranks.get(parts[best] + parts[best + 1], 1 << 60) >= token:
                    break
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            self.parts[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.parts[token]

    def adjacent(self, left: int, right: int) -> bool:
        """Whether encoding the two tokens' bytes together gives these two tokens again."""
        k = left * 65536 + right
        known = self.fits.get(k)
        if known is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            known = self.fits[k] = self._adjacent(left, right)
        return known

    def _adjacent(self, left: int, right: int) -> bool:
        # Undo merges from the latest on; at each stage a merge across the border would have had to come later.
        bound = 1 << 60
        while True:
            across = self.ranks.get(self.text[left] + self.text[right], 1 << 60)
            if across < bound:
                return False
            if left > right:
                parts = self.split(left)
                if parts is None:
                    parts = self.split(right)
                    if parts is None:
                        return True
                    bound, right = min(bound, right + 1), parts[0]
                else:
                    bound, left = min(bound, left), parts[1]
            else:
                parts = self.split(right)
                if parts is None:
                    parts = self.split(left)
                    if parts is None:
                        return True
                    bound, left = min(bound, left), parts[1]
                else:
                    bound, right = min(bound, right + 1), parts[0]

    def learn(self, words: list[str]) -> None:
        """Encode the words, given in any order, by one depth-first walk of their trie."""
        data = sorted((w.encode("utf-8", "replace"), w) for w in words)
        ends, adjacent = self.ends, self.adjacent
        last: list[int] = []  # by depth: token that ends here, and the depth where it begins
        begin: list[int] = []
        before = b""
        for w, word in data:
            keep, most = 0, min(len(w), len(before))
            while keep < most and w[keep] == before[keep]:
                keep += 1
            del last[keep:], begin[keep:]
            for d in range(keep, len(w)):
                node, at, found = ends, d, []
                while at >= 0:
                    node = node.get(w[at])
                    if node is None:
                        break
                    r = node.get(-1)
                    if r is not None:
                        found.append((at, r))
                    at -= 1
                for at, r in reversed(found):
                    if at == 0 or adjacent(last[at - 1], r):
                        last.append(r)
                        begin.append(at)
                        break
            out = []
            at = len(w)
            while at > 0:
                out.append(last[at - 1])
                at = begin[at - 1]
            self.words[word] = np.array(out[::-1], np.int32).tobytes()
            before = w

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the texts; null and empty texts have no ids."""
        split = [self.pattern.findall(t) if t else [] for t in texts]
        if len(self.words) > self.remember:
            self.words.clear()
        new = set().union(*split) - self.words.keys()
        if new:
            self.learn(list(new))
        joined = [b"".join(map(self.words.__getitem__, ws)) for ws in split]
        ends = np.cumsum([0] + [len(j) // 4 for j in joined])
        return ends, np.frombuffer(b"".join(joined), np.int32)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> TrieEncoder:
    return TrieEncoder(path)


def _chunks(batch: pa.RecordBatch, text: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes of text, so that long texts don't pile up; a text is never cut."""
    sizes = np.array([len(t) if t else 0 for t in batch.column(text).to_pylist()])
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if batch.num_rows > start:
        yield batch.slice(start)


def encode_texts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """``doc_id, ids array<int>`` of every row, without special tokens: text that looks like one is ordinary text.

    Null and empty texts have an empty list; repeated rows are encoded again, each gives its row; characters that
    UTF-8 cannot hold (lone surrogates) count as '?'. A null id stays null.
    """
    path = os.path.join(folder or TOKENIZERS, f"{vocabulary}.tiktoken")

    def run(batches):
        e = encoder(path)
        for b in batches:
            for c in _chunks(b, "text"):
                ends, ids = e.encode(c.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([c.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))], ["doc_id", "ids"])

    rows = spread(documents.select(documents[doc_id].alias("doc_id"), documents[text].alias("text")))
    return rows.mapInArrow(run, f"doc_id {rows.dtypes[0][1]}, ids array<int>")


def count_tokens(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """``doc_id, tokens`` of every row; null and empty texts have 0."""
    path = os.path.join(folder or TOKENIZERS, f"{vocabulary}.tiktoken")

    def run(batches):
        e = encoder(path)
        for b in batches:
            for c in _chunks(b, "text"):
                ends, _ = e.encode(c.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([c.column("doc_id"), pa.array(np.diff(ends).astype(np.int32))], ["doc_id", "tokens"])

    rows = spread(documents.select(documents[doc_id].alias("doc_id"), documents[text].alias("text")))
    return rows.mapInArrow(run, f"doc_id {rows.dtypes[0][1]}, tokens int")
