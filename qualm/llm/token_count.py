"""Operator 1: token counts by heap-and-linked-list byte-pair merging.

A text is cut at the vocabulary's added tokens, the rest into pieces by the byte-level pattern. A piece starts as
one symbol per byte in a linked list; a heap yields the adjacent pair of lowest rank (leftmost among equals), which
is merged until no known pair is left. The count is initial symbols minus merges; identifiers are never made.

Defined results: null and empty texts have 0 tokens; a piece of any length costs n log n; repeated pieces are read
from a cache of bounded size per worker, which changes no count. Other columns of the input are untouched.
"""
from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F

from .common import text_of

# Pieces of the public byte-level vocabulary.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

CACHED_PIECES, CACHED_LENGTH, LONG_TEXT = 600_000, 40, 1_000_000


def byte_symbols() -> dict[str, int]:
    """The vocabulary's printable character of each byte: itself if printable, else the next free one from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TokenCounter(dict):
    """piece -> number of tokens, filled as pieces are met."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_symbols()
        raw = lambda s: bytes(to_byte[c] for c in s)
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.ranks = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        added = spec.get("added_tokens", [])
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("added tokens that take neighbouring characters are not supported")
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.pieces = regex.compile(PIECES)

    def __missing__(self, piece: str) -> int:
        n = self.merged(piece.encode("utf-8", "replace"))
        if len(piece) <= CACHED_LENGTH and len(self) < CACHED_PIECES:
            self[piece] = n
        return n

    def merged(self, piece: bytes) -> int:
        """Symbols left when no known pair is adjacent."""
        n = len(piece)
        symbol = [piece[i:i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.ranks.get
        heap = [(r, i, symbol[i], symbol[i + 1]) for i in range(n - 1) if (r := rank((symbol[i], symbol[i + 1]))) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != a or j >= n or symbol[j] != b:
                continue  # one of the two has been merged since
            symbol[i], symbol[j] = a + b, b""
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank((symbol[i], symbol[k]))) is not None:
                    heapq.heappush(heap, (r, i, symbol[i], symbol[k]))
            if (k := before[i]) >= 0 and (r := rank((symbol[k], symbol[i]))) is not None:
                heapq.heappush(heap, (r, k, symbol[k], symbol[i]))
        return left

    def plain(self, text: str) -> int:
        if len(text) < LONG_TEXT:
            return sum(map(self.__getitem__, self.pieces.findall(text)))
        return sum(self[m.group()] for m in self.pieces.finditer(text))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.added is None or not self.added.search(text):
            return self.plain(text)
        total, at = 0, 0
        for m in self.added.finditer(text):
            total += self.plain(text[at:m.start()]) + 1
            at = m.end()
        return total + self.plain(text[at:])


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def token_count(text: Column, path: str) -> Column:
    """Tokens of a text column under the vocabulary file at ``path`` (a path that every worker has)."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = counter(path)
        for texts in batches:
            yield pd.Series([c.count(t) for t in texts], dtype="int64")

    return count(text_of(text))


def count_documents(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document. Repeated rows are counted each."""
    counted = docs.select(F.col("doc_id").alias("doc_id"), F.octet_length(text_of("text")).cast("long").alias("n_bytes"),
                          token_count(F.col("text"), path).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
