"""Connected components of match pairs, by joins."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local one will do only where the master is local."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and context.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir is unset: it must name a folder that all executors share")
    return named or os.path.join(tempfile.gettempdir(), "ledgerline-checkpoints")


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialises ``df`` in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


#: Removes the shuffle files of a query when it ends, instead of when the driver next collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(folder: str) -> Iterator[None]:
    """What is stored() within goes to ``folder``, which the caller deletes."""
    token = _SCRATCH.set(folder)
    try:
        yield
    finally:
        _SCRATCH.reset(token)


def scratched() -> bool:
    """Whether scratch() names a folder here."""
    return _SCRATCH.get() is not None


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what runs within go when it ends. A result that runs again computes its shuffles again."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder and all that is in it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def released(spark: SparkSession) -> Iterator[str]:
    """What is stored() within is deleted at the end; gives the folder from before, for what must outlive it."""
    outer = _SCRATCH.get() or shared_folder(spark)
    folder = f"{outer}/released-{uuid.uuid4().hex}"
    try:
        with scratch(folder):
            yield outer
    finally:
        remove(spark, folder)


def written(df: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """``df`` as files of compressed columns, in place of what is there, and as read from them; the shuffles that it took are removed."""
    with shuffles_removed(df.sparkSession):
        df.write.mode(mode).option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_slices(spark: SparkSession, path: str, slices: int, rows: Callable[[Callable[..., DataFrame]], DataFrame]) -> DataFrame:
    """As written(), a slice at a time, so that only one slice's shuffles and scans stand on disk.

    ``rows`` makes the table of a slice, given a function that takes a table and columns to the rows of the slice by these
    columns. Rows with equal values fall into one slice, nulls too; what ``rows`` makes of one mustn't depend on the others.
    """
    for i in range(slices):
        of = lambda df, *columns, i=i: df.filter(F.pmod(F.xxhash64(*columns), F.lit(slices)) == i) if slices > 1 else df
        with released(spark):
            out = written(rows(of), path, "append" if i else "overwrite")
    return out


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Materialises ``df`` as compressed columns in ``folder``, else in that of scratch(), else in the shared one; a checkpoint holds rows as they are in memory, several times the size.

    Columns that repeat a name or have no type are left to a checkpoint.
    """
    if len(set(df.columns)) < len(df.columns) or "void" in df.schema.simpleString():
        return checkpointed(df)
    return written(df, f"{folder or _SCRATCH.get() or shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}")


def connected_components(nodes: DataFrame, pairs: DataFrame, node: str = "node") -> DataFrame:
    """node and component, its smallest member, for every node; pairs are columns a and b.

    Labels travel along pairs and jump to their label's label, so long chains need few rounds.
    """
    both = checkpointed(pairs.select("a", "b").union(pairs.select("b", "a")).filter("a <> b").distinct())
    labels = checkpointed(nodes.select(F.col(node).alias("node"), F.col(node).alias("component")).distinct())
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("least"))
        lower = labels.join(near, labels["node"] == near["a"], "left").select("node", F.least("component", F.coalesce("least", "component")).alias("component"))
        up = lower.select(F.col("node").alias("via"), F.col("component").alias("jump"))
        jumped = lower.join(up, lower["component"] == up["via"], "left").select("node", F.least("component", F.coalesce("jump", "component")).alias("component"))
        after = checkpointed(jumped)
        changed = after.join(labels.select("node", F.col("component").alias("old")), "node").filter("component <> old").limit(1).count()
        labels = after
        if not changed:
            return labels
