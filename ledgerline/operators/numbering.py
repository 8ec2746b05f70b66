"""Row numbers over a whole order without a task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import scanned


def numbered(df: DataFrame, order: list[Column | str], name: str = "place", group: list[str] = ()) -> DataFrame:
    """``df`` with the row's number, from 1, in ``order``, or in the order of its ``group``.

    Rows that are equal in the order stand in one partition, numbered in any order.
    """
    return scanned(df, list(group), order, **{name: ("count", None)}).withColumn(name, F.col(name).cast("int"))


def identified(df: DataFrame, order: list[Column | str], prefix: str, width: int, name: str = "id") -> DataFrame:
    """``df`` with ids such as Q-000001 in ``order``."""
    return numbered(df, order, "_place").withColumn(name, F.concat(F.lit(prefix), F.lpad(F.col("_place").cast("string"), width, "0"))).drop("_place")
