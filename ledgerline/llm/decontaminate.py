"""Benchmark decontamination by pigeonhole edit matching.

An item of n words may differ from a passage by up to e = floor(n * ``budget``) word insertions, deletions and
substitutions. The item is cut into e + 1 pieces; an occurrence within the budget holds at least one piece exactly. Piece
hits are found by rolling hashes over whole texts, looked up in the sorted hashes of all pieces; around each hit the item
is verified with Myers' bit-parallel distance over words. Texts stay where they are read: nothing is shuffled. The
benchmark is broadcast in blocks of at most ``block_bytes``, each run against all rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, WORD, bound_batches, ids, mixed, text_bytes
from .quality_classifier import filter_rows

BUDGET = 0.2
BLOCK_BYTES = 16 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _hashes(words: list[bytes]) -> np.ndarray:
    return mixed(np.fromiter(map(zlib.crc32, words), np.uint32, len(words)))


def _grams(h: np.ndarray, length: int) -> np.ndarray:
    n = len(h) - length + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, length):
        out = out * _BASE + h[j : j + n]
    return out


def pieces(n: int, budget: float) -> list[tuple[int, int]]:
    """Start and length of the budget-plus-one pieces of an item of n words."""
    k = min(n, int(n * budget + 1e-9) + 1)
    edges = [n * i // k for i in range(k + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


class Matcher:
    """The pieces of a block of items (item_id, text); an item without words matches nothing."""

    def __init__(self, items: list[tuple[int, bytes]], budget: float = BUDGET):
        self.items, self.budget = [(i, WORD.findall(t.lower())) for i, t in items], budget
        found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for k, (_, words) in enumerate(self.items):
            if words:
                h = _hashes(words)
                for start, length in pieces(len(words), budget):
                    found[length].append((int(_grams(h[start : start + length], length)[0]), k, start))
        self.by_length = {}
        for length, rows in found.items():
            rows.sort()
            self.by_length[length] = (np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
        # One bit for each hash, by its top bits: most positions fail here, without a search.
        self.sieve = {}
        for length, (keys, _, _) in self.by_length.items():
            bits = np.zeros(1 << 20, bool)
            bits[(keys >> np.uint64(44)).astype(np.int64)] = True
            self.sieve[length] = bits

    def _hits(self, h: np.ndarray) -> Iterator[tuple[int, int]]:
        """Item and where its first word would stand."""
        for length, (keys, item, start) in self.by_length.items():
            grams = _grams(h, length)
            at = np.flatnonzero(self.sieve[length][(grams >> np.uint64(44)).astype(np.int64)])
            if len(at):
                low, high = np.searchsorted(keys, grams[at], "left"), np.searchsorted(keys, grams[at], "right")
                for p, a, b in zip(at[high > low], low[high > low], high[high > low], strict=True):
                    for r in range(a, b):
                        yield int(item[r]), int(p - start[r])

    def matches(self, text: bytes) -> dict[int, tuple[int, int]]:
        """Of each item found: smallest distance and where the first such occurrence ends (words, exclusive)."""
        words = WORD.findall(text.lower())
        if not words:
            return {}
        wanted = defaultdict(set)
        for k, at in self._hits(_hashes(words)):
            wanted[k].add(at)
        out = {}
        for k, places in wanted.items():
            item = self.items[k][1]
            e = int(len(item) * self.budget + 1e-9)
            masks: dict[bytes, int] = {}
            for j, w in enumerate(item):
                masks[w] = masks.get(w, 0) | 1 << j
            best, low, high = None, 0, -1
            for at in [*sorted(places), None]:
                if at is not None and high >= 0 and at - e <= high:
                    high = at + len(item) + e
                    continue
                if high >= 0:
                    distance, end = _myers(masks, len(item), words[max(0, low) : high])
                    if distance <= e and (best is None or distance < best[0]):
                        best = distance, max(0, low) + end
                if at is not None:
                    low, high = at - e, at + len(item) + e
            if best:
                out[k] = best
        return out


def _myers(masks: dict[bytes, int], m: int, words: list[bytes]) -> tuple[int, int]:
    """Smallest edit distance of the pattern to any stretch of words, and where that first ends."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, w in enumerate(words, 1):
        eq = masks.get(w, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(horizontal | plus))
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(vertical | up)), up & vertical
        if score < best:
            best, end = score, j
    return best, end


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[list[tuple[int, bytes]]]:
    """The items with a text, in blocks that each fit the driver and a broadcast."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text")).filter(F.length("text") > 0)
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-size // block_bytes)
    for b in range(n):
        block = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()
        yield sorted((NULL_ID if r["item_id"] is None else r["item_id"], bytes(r["text"])) for r in block)


def contaminated(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of ``docs`` and item found in it: doc_id, item_id, distance, end_word, n_words (of the item).

    Words are runs of letters, digits and non-ASCII characters, A to Z lower-cased. Null and empty texts hold nothing, and
    null, empty or wordless items are held by nothing. Items under 1 / budget words match exactly. Repeated rows give
    repeated results; repeated items give a row each; empty tables give an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    schema = "doc_id long, item_id long, distance int, end_word long, n_words int"
    texts, out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")), spark.createDataFrame([], schema)
    for block in _blocks(benchmark, block_bytes):
        own = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], own=own) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(own.value, budget)
            for batch in batches:
                rows = [(d.as_py(), k, *m) for d, t in zip(batch.column("doc_id"), batch.column("text"), strict=True) for k, m in matcher.matches(t.as_py()).items()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), ids(np.array([matcher.items[r[1]][0] for r in rows], np.int64)), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int64()), pa.array([len(matcher.items[r[1]][1]) for r in rows], pa.int32())],
                    names=["doc_id", "item_id", "distance", "end_word", "n_words"],
                )

        out = out.union(texts.mapInArrow(run, schema))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows that hold an item within the budget."""
    for block in _blocks(benchmark, block_bytes):
        own = docs.sparkSession.sparkContext.broadcast(block)

        def clean(own=own):
            matcher = Matcher(own.value, budget)
            return lambda texts: np.array([not matcher.matches(t) for t in texts], bool)

        docs = filter_rows(docs, clean)
    return docs
