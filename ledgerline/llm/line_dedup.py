"""Line dedup by range-partitioned hashes.

Each line long enough becomes a row of a 128-bit hash of its key, its document and its position. The rows are
range-partitioned on hash and document, sorted by document (largest first) and position, and streamed: the first document
of a key keeps its lines, all others lose theirs once the key has been seen in enough documents. The document is part of
the range key, so a line that a third of all documents hold spreads over many partitions; keys that touch the edge of a
batch leave one summary row each and are settled by a join on the key. What comes back is a compressed bitmap of kept
lines for each document, not text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, bound_batches, cut, ids, longs, spread_join, text_bytes

ROW_SCHEMA = "h1 long, h2 long, doc_id long, tid long, pos int, n_docs long, is_open boolean, is_head boolean"


def _first_occurrences(min_docs: int):
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            h1, h2, doc = (longs(batch.column(c)) for c in ("h1", "h2", "doc_id"))
            head, new_doc = np.ones(n, bool), np.ones(n, bool)
            head[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            new_doc[1:] = head[1:] | (doc[1:] != doc[:-1])
            new_doc[0] = last != (h1[0], h2[0], doc[0])
            last = (h1[-1], h2[-1], doc[-1])
            starts, run = np.flatnonzero(head), np.cumsum(head) - 1
            n_docs = np.add.reduceat(new_doc.astype(np.int64), starts)
            is_open = (run == 0) | (run == run[-1])
            lost = (n_docs[run] >= min_docs) & (doc != doc[starts][run])
            at = np.flatnonzero(is_open | lost)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1[at]), pa.array(h2[at]), ids(doc[at]), batch.column("tid").take(pa.array(at)), batch.column("pos").take(pa.array(at)), pa.array(n_docs[run][at]), pa.array(is_open[at]), pa.array(head[at])],
                names=["h1", "h2", "doc_id", "tid", "pos", "n_docs", "is_open", "is_head"],
            )

    return stream


def line_drops(docs: DataFrame, min_length: int = 40, min_docs: int = 5) -> DataFrame:
    """The lines to drop: doc_id, tid (hash of the text) and pos, from 0."""
    bound_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tid"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    key = ascii_lower(F.btrim(F.col("line"), F.lit(SPACE)))
    keyed = lines.select("doc_id", "tid", "pos", key.alias("key")).filter(F.length("key") >= min_length)
    rows = keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), F.col("key")).alias("h2"), "doc_id", "tid", "pos")
    order = ["h1", "h2", F.col("doc_id").desc_nulls_last()]
    seen = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order, "pos").mapInArrow(_first_occurrences(min_docs), ROW_SCHEMA))
    whole = seen.filter("is_open and is_head").groupBy("h1", "h2").agg(F.sum("n_docs").alias("whole"), F.max("doc_id").alias("keeper")).filter(F.col("whole") >= min_docs)
    late = spread_join(seen.filter("is_open").select("h1", "h2", "doc_id", "tid", "pos"), whole, ["h1", "h2"], "whole").filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return seen.filter("not is_open").select("doc_id", "tid", "pos").unionByName(late.select("doc_id", "tid", "pos")).distinct()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = []
        for n, lost in zip(batch.column("n_lines").to_pylist(), batch.column("lost").to_pylist(), strict=True):
            keep = np.ones(n, bool)
            keep[lost] = False
            maps.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tid"), batch.column("n_lines"), pa.array([len(x) for x in batch.column("lost").to_pylist()], pa.int64()), pa.array(maps, pa.binary())], names=["doc_id", "tid", "n_lines", "n_dropped", "keep_bitmap"])


def line_dedup(docs: DataFrame, min_length: int = 40, min_docs: int = 5) -> DataFrame:
    """One row for each document: doc_id, tid, n_lines, n_dropped, keep_bitmap (zlib over little-endian bits, 1 for kept).

    A line's key is the line, stripped of ASCII white space at both ends, with A to Z lower-cased. A key of at least
    ``min_length`` code points found in at least ``min_docs`` documents loses all its lines but those of the largest
    doc_id; a null doc_id counts as smallest. Null or empty text is one empty line. Rows with the same doc_id and the
    same text are one document and give one row; rows with the same doc_id and other texts count as one document for
    ``min_docs`` and give a row each. An empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lost = line_drops(docs, min_length, min_docs).groupBy("doc_id", "tid").agg(F.collect_list("pos").alias("lost"))
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tid"), F.size(F.split(text, "\n")).cast("long").alias("n_lines")).distinct()
    both = sizes.alias("s").join(lost.alias("l"), F.expr("s.doc_id <=> l.doc_id and s.tid = l.tid"), "left")
    return both.select("s.doc_id", "s.tid", "n_lines", F.coalesce("lost", F.array().cast("array<int>")).alias("lost")).mapInArrow(_pack, "doc_id long, tid long, n_lines long, n_dropped long, keep_bitmap binary")


def _unpack(bitmap: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n, bitorder="little").view(bool)


def _rebuild(with_text: bool):
    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for text, bitmap, dropped in zip(batch.column("text").to_pylist(), batch.column("keep_bitmap").to_pylist(), batch.column("n_dropped").to_pylist(), strict=True):
                if dropped:
                    lines = text.split(b"\n")
                    text = b"\n".join(x for x, k in zip(lines, _unpack(bitmap, len(lines)), strict=True) if k)
                kept.append(text)
            out = {c: batch.column(c) for c in ("doc_id", "n_lines", "n_dropped")} | {"kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())}
            if with_text:
                out["kept_text"] = pa.array([x.decode() for x in kept], pa.string())
            yield pa.RecordBatch.from_pydict(out)

    return rebuild


def kept_texts(docs: DataFrame, min_length: int = 40, min_docs: int = 5, with_text: bool = True) -> DataFrame:
    """The bitmaps of line_dedup() applied, a row for each row of ``docs``: doc_id, n_lines, n_dropped, kept_sha256 and, ``with_text``, kept_text."""
    maps = line_dedup(docs, min_length, min_docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("tid"), text_bytes().alias("text"))
    both = texts.alias("t").join(maps.alias("m").hint("shuffle_hash"), F.expr("t.doc_id <=> m.doc_id and t.tid = m.tid"))
    return both.select("t.doc_id", "n_lines", "n_dropped", "keep_bitmap", "t.text").mapInArrow(_rebuild(with_text), "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + ", kept_text string" * with_text)
