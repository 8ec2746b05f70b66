"""SimHash near-dedup by anchor-point covering.

Fingerprints link at ``3`` or fewer differing bits. Of the two 32-bit halves of such a pair, one differs in at most one
bit, so anchors are chosen for each half: the perfect Hamming code of 31 bits times one free bit has covering radius 1.
A fingerprint is replicated to every anchor within covering radius plus threshold, 1 + 1, of each half: 17 copies at most
for a half, one of which is its home (the anchor within the radius). If two fingerprints link, one's home is among the
other's anchors, so comparing the homes of an anchor with all its members finds every link. Only fingerprints that differ
are replicated; equal ones share a representative.

An anchor with many homes is dealt anew by anchors of the other half, whose two 16-bit quarters are covered by the Hamming
code of 15 bits times one free bit: three differing bits leave one quarter with at most one. An anchor's members are
streamed against its homes, and for large anchors a spanning forest leaves the task, never all pairs. Components come from
alternating large-star and small-star steps, which run as joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, longs, only_rows, spread_join, text_bytes

SHINGLE, SEED, MAX_BITS = 3, 42, 3
#: Anchors with more homes than this are dealt anew; groups of more rows than SMALL are compared one by one.
HEAVY, SMALL, BLOCK = 4096, 32, 1 << 21
FORMAT = "key long, home boolean, rep long, fp long"


def _fingerprint(text: bytes) -> int:
    words = text.lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else [b" ".join(words)]
    n = max(1, len(words) - SHINGLE + 1)
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 16384):
        ones += np.unpackbits(h[i : i + 16384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array([_fingerprint(t.as_py()) for t in batch.column("text")], pa.int64())], names=["doc_id", "h", "fp"])


def text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, a hash h of the text and fp (the 64 bits as a signed long) for each row; null text counts as empty and has fingerprint zero."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("h"), text_bytes().alias("text")).mapInArrow(_fingerprints, "doc_id long, h long, fp long")


def _hamming(bits: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of the Hamming code of 2**r - 1 bits: by syndrome, the flip that leads home and the flips to all codewords within two."""
    size = 1 << bits
    bit = lambda p: np.uint64(1 << (p - 1)) if p else np.uint64(0)
    near = [np.array([0], np.uint64)] + [np.array([bit(s), *(bit(a) | bit(a ^ s) for a in range(1, size) if a < a ^ s)], np.uint64) for s in range(1, size)]
    return np.array([bit(s) for s in range(size)]), near


CODES = {31: (5, *_hamming(5)), 15: (4, *_hamming(4))}


def _anchors(part: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For parts of ``n + 1`` bits: row, anchor and whether it is home, for each anchor within two of each part."""
    r, home_flip, near = CODES[n]
    code, free = part & np.uint64((1 << n) - 1), part & np.uint64(1 << n)
    syndrome = np.zeros(len(part), np.int64)
    for p in range(1, n + 1):
        syndrome ^= ((code >> np.uint64(p - 1)) & np.uint64(1)).astype(np.int64) * p
    rows, anchors, home = [], [], []
    for s in range(1 << r):
        at = np.flatnonzero(syndrome == s)
        if len(at):
            flips = near[s]
            rows += [np.repeat(at, len(flips)), at]
            own = code[at] ^ home_flip[s]
            anchors += [((code[at, None] ^ flips) | free[at, None]).ravel(), own | (free[at] ^ np.uint64(1 << n))]
            home += [np.tile(np.arange(len(flips)) == 0, len(at)), np.zeros(len(at), bool)]
    return np.concatenate(rows), np.concatenate(anchors), np.concatenate(home)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, fp) to its anchors in both halves."""
    for batch in batches:
        rep, fp = longs(batch.column("rep")), longs(batch.column("fp")).view(np.uint64)
        for start in range(0, len(fp), 4096):
            for half in (0, 1):
                own = fp[start : start + 4096]
                row, anchor, home = _anchors((own >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF), 31)
                yield pa.RecordBatch.from_arrays([pa.array((anchor | np.uint64(half << 32)).view(np.int64)), pa.array(home), pa.array(rep[start : start + 4096][row]), pa.array(own[row].view(np.int64))], names=["key", "home", "rep", "fp"])


def _replicate_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of heavy anchors to the anchors of both quarters of the other half; the key holds both anchors, hashed."""
    for batch in batches:
        if not batch.num_rows:
            continue
        key, home = longs(batch.column("key")).view(np.uint64), batch.column("home").to_numpy(zero_copy_only=False)
        rep, fp = longs(batch.column("rep")), longs(batch.column("fp")).view(np.uint64)
        other = (fp >> (np.uint64(32) * (np.uint64(1) - (key >> np.uint64(32))))) & np.uint64(0xFFFFFFFF)
        for quarter in (0, 1):
            row, anchor, own = _anchors((other >> np.uint64(16 * quarter)) & np.uint64(0xFFFF), 15)
            # 33 bits of the first key, one of the quarter and 16 of its anchor: 50 bits, so keys stay distinct.
            again = (key[row] << np.uint64(17)) | np.uint64(quarter << 16) | anchor
            yield pa.RecordBatch.from_arrays([pa.array(again.view(np.int64)), pa.array(home[row] & own), pa.array(rep[row]), pa.array(fp[row].view(np.int64))], names=["key", "home", "rep", "fp"])


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= MAX_BITS


class _Forest:
    """Union-find over the homes of one anchor, fed with blocks of members; edges() joins each to its root."""

    def __init__(self, rep: np.ndarray, fp: np.ndarray):
        self.rep, self.fp, self.parent = rep, fp, np.arange(len(fp))

    def _roots(self) -> np.ndarray:
        while not np.array_equal(up := self.parent[self.parent], self.parent):
            self.parent = up
        return self.parent

    def take(self, rep: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        step = max(1, BLOCK // len(self.fp))
        for i in range(0, len(fp), step):
            row, col = np.nonzero(_near(fp[i : i + step, None], self.fp[None, :]))
            if not len(row):
                continue
            while True:
                roots = self._roots()[col]
                least = np.full(min(step, len(fp) - i), len(self.fp))
                np.minimum.at(least, row, roots)
                if (roots == least[row]).all():
                    break
                np.minimum.at(self.parent, roots, least[row])
            hit, first = np.unique(row, return_index=True)
            yield rep[i : i + step][hit], self.rep[col[first]]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        return self.rep, self.rep[self._roots()]


def _batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    differ = a != b
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)[differ]), pa.array(np.minimum(a, b)[differ])], names=["u", "v"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, homes first, to edges between representatives. Keeps one anchor's homes, and under SMALL rows besides."""
    big: tuple[int, list, _Forest | None] | None = None  # key, homes so far, forest once all homes are in
    rest = None

    def finish():
        _, homes, forest = big
        if forest is None and homes:
            forest = _Forest(*(np.concatenate(x) for x in zip(*homes, strict=True)))
            yield from (_batch(*x) for x in forest.take(forest.rep, forest.fp))
        if forest:
            yield _batch(*forest.edges())

    def feed(home, rep, fp):
        nonlocal big
        key, homes, forest = big
        if home.any():
            homes.append((rep[home], fp[home]))
        if not home.all() and homes:
            if forest is None:
                forest = _Forest(*(np.concatenate(x) for x in zip(*homes, strict=True)))
                yield from (_batch(*x) for x in forest.take(forest.rep, forest.fp))
            yield from (_batch(*x) for x in forest.take(rep[~home], fp[~home]))
        big = key, homes, forest

    def groups(key, home, rep, fp, done: bool):
        """Settles all groups but, unless done, the last, and gives back what is left."""
        nonlocal big
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(starts, len(key)))
        if big is not None:
            if key[0] == big[0]:
                yield from feed(home[: sizes[0]], rep[: sizes[0]], fp[: sizes[0]])
                if len(starts) == 1 and not done:
                    return None
                starts, sizes = starts[1:], sizes[1:]
            yield from finish()
            big = None
        if not len(starts):
            return None
        left = None
        if not done:
            left = starts[-1]
            if sizes[-1] > SMALL:
                big = (key[left], [], None)
                yield from feed(home[left:], rep[left:], fp[left:])
                left = None
            starts, sizes = starts[:-1], sizes[:-1]
        for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
            own = big
            big = (key[s], [], None)
            yield from feed(home[s : s + n], rep[s : s + n], fp[s : s + n])
            yield from finish()
            big = own
        if len(starts):
            small = np.repeat(sizes <= SMALL, sizes)
            lo, hi = starts[0], starts[-1] + sizes[-1]
            at = np.arange(lo, hi)[small]
            for shift in range(1, int(sizes[sizes <= SMALL].max(initial=1))):
                i, j = at[:-shift], at[shift:]
                same = (key[i] == key[j]) & (home[i] | home[j])
                i, j = i[same], j[same]
                hit = _near(fp[i], fp[j])
                if hit.any():
                    yield _batch(rep[i[hit]], rep[j[hit]])
        return None if left is None else tuple(x[left:] for x in (key, home, rep, fp))

    for batch in batches:
        if not batch.num_rows:
            continue
        now = (longs(batch.column("key")), batch.column("home").to_numpy(zero_copy_only=False), longs(batch.column("rep")), longs(batch.column("fp")).view(np.uint64))
        if rest is not None:
            now = tuple(np.concatenate(x) for x in zip(rest, now, strict=True))
        rest = yield from groups(*now, False)
    if rest is not None:
        yield from groups(*rest, True)
    elif big is not None:
        yield from finish()


def _edges(anchored: DataFrame) -> DataFrame:
    return anchored.repartition("key").sortWithinPartitions("key", F.col("home").desc()).mapInArrow(_compare, "u long, v long")


def links(reps: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """Edges u > v that join the representatives (rep, fp; each fp once) as all their links would."""
    spark = reps.sparkSession
    bound_batches(spark)
    anchored = reps.mapInArrow(_replicate, FORMAT)
    crowded = cut(anchored.filter("home").groupBy("key").count().filter(F.col("count") > heavy).select("key"))
    n = crowded.count()
    if not n:
        return _edges(anchored).distinct()
    small = F.broadcast(crowded) if n <= 500_000 else crowded
    again = anchored.join(small, "key", "left_semi").select("key", "home", "rep", "fp").mapInArrow(_replicate_again, FORMAT)
    return _edges(anchored.join(small, "key", "left_anti").select("key", "home", "rep", "fp")).unionByName(_edges(again)).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) for every node of the undirected edges (u, v)."""
    edges, before = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()), None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == before or not mark[0]:
            break
        before = tuple(mark)
        both = edges.union(edges.select("v", "u")).toDF("a", "b")
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
    return edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")


def _groups(docs: DataFrame, heavy: int) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` as (doc_id, h, fp), h a hash of the text, and the component (its smallest fingerprint) of each fp."""
    prints = cut(fingerprints(docs).select("doc_id", "h", "fp"))
    reps = cut(prints.select("fp").distinct().select("fp", F.col("fp").alias("rep")))
    found = components(links(reps, heavy))
    return prints, reps.join(found, reps["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component"))


def simhash_dedup(docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links).

    Texts without words, empty and null ones have fingerprint zero and link like any other. A row whose doc_id is null
    takes part under the smallest long, so its component_id is null. Rows link by their fingerprints alone: rows that share
    a doc_id may be of different components. Repeated rows are equal rows of the result; an empty table gives an empty
    result; columns other than doc_id and text are ignored.
    """
    prints, groups = _groups(docs, heavy)
    floor = F.lit(int(np.iinfo(np.int64).min))
    # A fingerprint that many rows have is one row before it meets its component.
    least = prints.groupBy("fp").agg(F.min(F.coalesce("doc_id", floor)).alias("least"), F.count("*").alias("n")).join(groups, "fp")
    named = least.select("fp", "component", "n").join(least.groupBy("component").agg(F.min("least").alias("component_id")), "component")
    return spread_join(prints.select("doc_id", "fp"), named, ["fp"], "n").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.nullif(F.col("component_id"), floor).alias("component_id")
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest doc_id, null first, then the smallest hash of the text.

    Rows are told apart by doc_id and text; of rows repeated with both one stays. An empty table gives an empty result.
    """
    prints, groups = _groups(docs, HEAVY)
    floor = F.lit(int(np.iinfo(np.int64).min))
    row = F.struct(F.coalesce("doc_id", floor).alias("doc_id"), "h")
    least = prints.groupBy("fp").agg(F.min(row).alias("least")).join(groups, "fp").groupBy("component").agg(F.min("least").alias("least"))
    kept = least.select(F.nullif(F.col("least.doc_id"), floor).alias("doc_id"), "least.h")
    return only_rows(docs, kept, text_hash())
