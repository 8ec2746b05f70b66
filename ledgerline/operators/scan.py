"""Running sums, look-backs and look-aheads along an order, for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import checkpointed, scratched, stored


def scanned(df: DataFrame, group: list[str], order: list[Column | str], **made: tuple[str, str | None]) -> DataFrame:
    """``df`` with a column for each of ``made``: what the rows of the ``group`` up to this one, in ``order``, come to.

    Each is (kind, column): count (no column), sum, min or last (the last that isn't null) of the rows so far, this one
    included; or next, the value in the row that follows (null in the last one). Null groups are a group.

    Rows are partitioned by range of group and order, so a group that holds most rows spreads over many partitions. Each
    partition is scanned on its own; a group that goes over several takes what its earlier parts come to, or the first row of
    its next part, from a list of those parts: at most two for each partition, so it is broadcast. Rows that are equal in the
    order stay together; let it end in what tells rows apart.
    """
    within = Window.partitionBy("_scan_p", *group).orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    here = {
        "count": lambda _: F.row_number().over(within).cast("long"), "sum": lambda c: F.sum(c).over(upto), "min": lambda c: F.min(c).over(upto),
        "last": lambda c: F.last(c, ignorenulls=True).over(upto), "next": lambda c: F.lead(c).over(within),
    }
    placed = df.repartitionByRange(*group, *order).withColumn("_scan_p", F.spark_partition_id())
    keep = stored if scratched() else checkpointed  # small files are read back in fewer tasks than a checkpoint
    own = keep(placed.withColumns({name: here[kind](c) for name, (kind, c) in made.items()} | {"_scan_n": F.row_number().over(within), "_scan_ends": F.lead(F.lit(1)).over(within).isNull()}))
    # What each part of a group comes to: its last row's running values, and what its first row shows to the part before.
    held = own.groupBy("_scan_p", *group).agg(*((F.min_by(c, "_scan_n") if kind == "next" else F.max_by(name, "_scan_n")).alias(f"_scan_of_{name}") for name, (kind, c) in made.items()))
    parts = Window.partitionBy(*group).orderBy("_scan_p")
    before = parts.rowsBetween(Window.unboundedPreceding, -1)
    carried = {
        "count": lambda c: F.sum(c).over(before), "sum": lambda c: F.sum(c).over(before), "min": lambda c: F.min(c).over(before),
        "last": lambda c: F.last(c, ignorenulls=True).over(before), "next": lambda c: F.lead(c).over(parts),
    }
    every = Window.partitionBy(*group)
    spread = held.withColumn("_scan_parts", F.count("*").over(every)).select("_scan_p", *group, *(carried[kind](f"_scan_of_{name}").alias(f"_scan_to_{name}") for name, (kind, _) in made.items()), "_scan_parts").filter("_scan_parts > 1")
    carry = spread.select(F.col("_scan_p").alias("_scan_q"), *(F.col(g).alias(f"_scan_g_{g}") for g in group), *(f"_scan_to_{name}" for name in made))
    same = F.col("_scan_p") == F.col("_scan_q")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_scan_g_{g}"))
    joined = own.join(F.broadcast(carry), same, "left")
    whole = {
        "count": lambda name: F.col(name) + F.coalesce(f"_scan_to_{name}", F.lit(0)), "min": lambda name: F.least(name, f"_scan_to_{name}"), "last": lambda name: F.coalesce(name, f"_scan_to_{name}"),
        "sum": lambda name: F.when(F.col(f"_scan_to_{name}").isNull(), F.col(name)).otherwise(F.coalesce(name, F.lit(0)) + F.col(f"_scan_to_{name}")),
        "next": lambda name: F.when(F.col("_scan_ends"), F.col(f"_scan_to_{name}")).otherwise(F.col(name)),
    }
    return joined.select(*df.columns, *(whole[kind](name).cast(own.schema[name].dataType).alias(name) for name, (kind, _) in made.items()))
