"""Core conformance: references brought to one spelling, parents found, rows kept whatever becomes of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip


def folded(c: Column) -> Column:
    """How a reference is compared with an alias: without white space at the ends, inner runs of it as one space, in lower case."""
    return F.lower(F.regexp_replace(strip(c), r"\s+", " "))


def with_alias(df: DataFrame, column: str, aliases: DataFrame, canonical: str) -> DataFrame:
    """``df`` with ``canonical``, the canonical value that ``aliases`` (alias, canonical) gives to a column, null where it knows none.

    The table of aliases is made unique first, the smallest canonical value winning, so no row is doubled; null has no alias.
    """
    known = aliases.filter("alias IS NOT NULL").groupBy(folded(F.col("alias")).alias("_alias")).agg(F.min("canonical").alias(canonical))
    return df.withColumn("_alias", folded(F.col(column))).join(known, "_alias", "left").drop("_alias")


def with_parent(df: DataFrame, column: str, parents: DataFrame, key: str, flag: str) -> DataFrame:
    """``df`` with whether its reference names a parent; false for null, and rows without a parent stay."""
    known = parents.select(F.col(key).alias("_key")).filter("_key IS NOT NULL").distinct().withColumn("_known", F.lit(True))
    return df.join(known, df[column] == known["_key"], "left").withColumn(flag, F.coalesce("_known", F.lit(False))).drop("_key", "_known")


def assert_no_row_lost(before: DataFrame, after: DataFrame) -> int:
    """The number of rows of both; conformance neither gains nor loses one."""
    n, m = before.count(), after.count()
    if n != m:
        raise AssertionError(f"{n} rows before conformance, {m} after")
    return n


def coverage(df: DataFrame, flags: list[str]) -> DataFrame:
    """check, matched and unmatched for each flag, in one pass."""
    sums = df.agg(*(F.count_if(F.col(f)).alias(f) for f in flags), F.count("*").alias("_n"))
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("check"), F.col(f).alias("matched"), (F.col("_n") - F.col(f)).alias("unmatched")) for f in flags)))
    return sums.select(pairs.alias("c")).select("c.*")


def modal(value: str, n: str = "_n") -> Column:
    """Of counted values the most frequent, ties by value; nulls don't vote."""
    return F.min(F.when(F.col(value).isNotNull(), F.struct((-F.col(n)).alias("o"), F.col(value).alias("v"))))["v"]


def roll_up(df: DataFrame, key: str, mode_of: str, *measures: Column) -> DataFrame:
    """One row for each ``key``: the modal ``mode_of`` and the measures. Values are counted before the groups meet."""
    votes = df.groupBy(key, mode_of).agg(F.count("*").alias("_n")).groupBy(key).agg(modal(mode_of).alias(mode_of))
    return df.groupBy(key).agg(*measures).join(votes, key)
