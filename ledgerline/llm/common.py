"""Helpers that the corpus operators share."""

from __future__ import annotations

import os
import re
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The white space of the contracts: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
#: Words of letters, digits and everything beyond ASCII, in lower-cased UTF-8.
WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
NULL_ID = np.iinfo(np.int64).min
#: Rows of one key that a copy of its verdict serves.
SHARE = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that Python workers get, in rows and in bytes, so long texts cannot fill a worker.

    The bounds are the session's and the same for every operator, so it doesn't matter which one was built last.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16384")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def cut(df: DataFrame) -> DataFrame:
    """Materialises ``df`` in the shared checkpoint folder, so lost executors cost no recomputation."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one where that is unset and the master is local, as in tests."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("spark.checkpoint.dir is unset: it must name a folder that all executors share")
    return named or os.path.join(tempfile.gettempdir(), "ledgerline-checkpoints")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, by Spark's own file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def ascii_lower(column):
    """Lower-cases A to Z only, unlike lower(), which follows Unicode."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_bytes(name: str = "text"):
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def longs(column: pa.Array) -> np.ndarray:
    """An int64 array in which nulls are the smallest long."""
    return column.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def ids(values: np.ndarray) -> pa.Array:
    """The inverse of longs()."""
    return pa.array(values, type=pa.int64(), mask=values == NULL_ID)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over unsigned longs."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spread_join(rows: DataFrame, verdicts: DataFrame, keys: list[str], n: str, share: int = SHARE) -> DataFrame:
    """``rows`` with the one row of ``verdicts`` for their keys, of which ``n`` rows or fewer have each.

    A key of more than ``share`` rows is dealt to several copies of its verdict, so no task gets all of them. Such keys are
    the rows' number / ``share`` at most, so their list can be broadcast; where there is none the join is a plain one.
    """
    hot = verdicts.filter(F.col(n) > share).select(*keys, F.ceil(F.col(n) / share).cast("int").alias("_copies"))
    if not hot.head(1):
        return rows.join(verdicts, keys)
    hot, verdicts = cut(hot), cut(verdicts)
    one = F.lit(1)
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_copy", F.floor(F.rand(0) * F.coalesce("_copies", one)).cast("int")).drop("_copies")
    copied = verdicts.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col(n) / share).cast("int"), one) - 1)))
    return dealt.join(copied, [*keys, "_copy"]).drop("_copy")


def only_rows(docs: DataFrame, kept: DataFrame, h: Column, *first: Column) -> DataFrame:
    """``docs`` with one row for each row (doc_id, h) of ``kept``: the first by ``first`` of those with that doc_id and hash."""
    doc = F.col("doc_id").cast("long")
    key = F.struct(F.coalesce(doc, F.lit(0)).alias("id"), doc.isNull().alias("none"))
    # Maps and variants can't be hashed, but their JSON can.
    told = [F.to_json(F.struct(F.col(f"`{c}`").alias("c"))) if re.search("map<|variant", kind) else F.col(f"`{c}`") for c, kind in docs.dtypes]
    named = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key.alias("key"), h.alias("h"), F.struct(F.lit(0), *first, F.xxhash64(*told)).alias("place"))
    # Rows and verdicts meet by the same columns that number the rows, so texts are shuffled once.
    met = named.join(kept.select(key.alias("key"), "h").hint("shuffle_hash"), ["key", "h"], "left_semi")
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("key", "h").orderBy("place")))
    return ranked.filter("rank = 1").select("row.*")
