"""Exact dedup by content sort.

Texts are normalised by deleting ASCII white space. Splitters sampled by Spark range-partition the rows on the first
bytes of the normalised text, a 64-bit hash of it and doc_id; an external sort in each partition places equal texts next
to each other, and neighbouring texts are compared in full. doc_id is part of the range key, so a group that holds a
third of all rows spreads over many partitions. Runs of equal texts that lie inside one batch are settled on the spot;
runs that touch the edge of a batch leave one summary row, and summaries of the same text meet on its SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, bound_batches, cut, ids, longs, only_rows, spread_join

PREFIX = 48
RUN_SCHEMA = "doc_id long, h long, keep_id long, best_points long, group_size long, text_sha256 string, is_open boolean, is_head boolean"


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        norm = batch.column("norm")
        head = np.ones(n, bool)
        head[1:] = pc.not_equal(norm[1:], norm[:-1]).to_numpy(zero_copy_only=False)
        starts, run = np.flatnonzero(head), np.cumsum(head) - 1
        doc, points = longs(batch.column("doc_id")), batch.column("n_points").to_numpy()
        best = np.lexsort((doc, -points, run))[starts]
        sha = np.array([hashlib.sha256(norm[int(s)].as_py()).hexdigest() for s in starts], dtype=object)
        yield pa.RecordBatch.from_arrays(
            [
                ids(doc), batch.column("h"), ids(doc[best][run]), pa.array(points[best][run], pa.int64()),
                pa.array(np.diff(np.append(starts, n))[run], pa.int64()), pa.array(sha[run], pa.string()),
                pa.array((run == 0) | (run == run[-1])), pa.array(head),
            ],
            names=["doc_id", "h", "keep_id", "best_points", "group_size", "text_sha256", "is_open", "is_head"],
        )


def _normalised(text: Column) -> Column:
    return F.translate(text, SPACE, "")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null and empty texts, and texts of white space alone, are one group. Of equal texts the row with the most code points
    before normalising stays, then the smallest doc_id; a null doc_id counts as smallest. Rows repeated with the same
    doc_id each count in group_size and carry the same verdict. An empty table gives an empty result; columns other than
    doc_id and text are ignored.
    """
    return _judged(docs).drop("h")


def _judged(docs: DataFrame) -> DataFrame:
    """exact_dedup() with the hash h of the normalised text."""
    bound_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    norm = _normalised(text)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.length(text).cast("long").alias("n_points"),
        F.substring(norm, 1, PREFIX).alias("prefix"), F.xxhash64(norm).alias("h"), norm.cast("binary").alias("norm"),
    )
    ordered = rows.repartitionByRange("prefix", "h", "doc_id").sortWithinPartitions("prefix", "h", "norm", "doc_id")
    runs = cut(ordered.select("doc_id", "h", "n_points", "norm").mapInArrow(_settle, RUN_SCHEMA))
    merged = (
        runs.filter("is_open and is_head").groupBy("text_sha256")
        .agg(F.sum("group_size").alias("whole"), F.min(F.struct((-F.col("best_points")).alias("p"), "keep_id")).alias("best"))
        .select("text_sha256", "whole", F.col("best.keep_id").alias("stays"))
    )
    settled = runs.filter("not is_open").select("doc_id", "h", "keep_id", "group_size", "text_sha256")
    joined = spread_join(runs.filter("is_open").select("doc_id", "h", "text_sha256"), merged, ["text_sha256"], "whole").select("doc_id", "h", F.col("stays").alias("keep_id"), F.col("whole").alias("group_size"), "text_sha256")
    return settled.unionByName(joined).select("doc_id", "h", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts: the one that exact_dedup() lets stay.

    Rows are told apart by doc_id and text, so a row isn't kept for another one with its doc_id, and of rows repeated with
    both one stays. Null texts, repeated and null ids and an empty table are as in exact_dedup().
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = _judged(docs).filter("kept").select("doc_id", "h").distinct()
    return only_rows(docs, kept, F.xxhash64(_normalised(text)), -F.length(text))
