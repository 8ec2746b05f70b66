"""First-in first-out allocation of supply to demand, as merges of running sums."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import released, stored
from .scan import scanned


def _cuts(ends: DataFrame, key: str) -> DataFrame:
    """Where a key's quantity is cut. ``ends``: key, _to, supply_id, demand_id, one of them null, unique by key, _to and side."""
    return ends.groupBy(key, "_to").agg(F.max("supply_id").alias("supply_id"), F.max("demand_id").alias("demand_id"))


def _served(cuts: DataFrame, key: str, amount: Column) -> DataFrame:
    """The stretches between neighbouring ``_to`` of a key's cuts: each goes from the next supply to end to the next demand to end."""
    looked = scanned(cuts, [key], [F.col("_to").desc()], s=("last", "supply_id"), d=("last", "demand_id"), _from=("next", "_to"))
    served = looked.select(key, F.col("s").alias("supply_id"), F.col("d").alias("demand_id"), (F.col("_to") - F.coalesce("_from", F.lit(0))).alias("allocated"))
    return served.filter("supply_id IS NOT NULL AND demand_id IS NOT NULL").withColumn("allocated", amount)


def fifo(supply: DataFrame, demand: DataFrame, key: str, supply_order: list[str], demand_order: list[str], quantity: str = "quantity") -> DataFrame:
    """Allocations without a deadline, as a merge of the running sums of both sides: no row loop, and no pair that allocates nothing.

    The sums of both sides cut a key's quantity into stretches; each is served by the first supply that ends at or after its
    end and goes to the first such demand, found by looking ahead in one order. Orders must be total, and of the same types on
    both sides. Gives key, supply_id, demand_id and allocated, for supply rows with supply_id and demand rows with demand_id.
    A key's rows spread over partitions, so none need be small.
    """
    side = lambda df, name, order: df.filter(F.col(quantity) > 0).select(key, F.lit(name).alias("_side"), F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order))).alias("_o"), F.col(quantity).alias("_q"), F.col(f"{name}_id"))
    both = side(supply, "supply", supply_order).unionByName(side(demand, "demand", demand_order), allowMissingColumns=True)
    with released(supply.sparkSession) as outer:
        cuts = stored(_cuts(scanned(both, [key, "_side"], ["_o"], _to=("sum", "_q")), key), outer)
    return _served(cuts, key, F.col("allocated"))


EXACT = "decimal(38,6)"


def fifo_with_deadline(supply: DataFrame, demand: DataFrame, key: str) -> DataFrame:
    """As fifo(), but a supply may only serve demands whose deadline it meets; what a demand cannot use stays for later ones.

    supply: key, supply_id, at, quantity; demand: key, demand_id, at, deadline, quantity. Demands come in order of at and
    demand_id, supplies in order of at and supply_id. Where a key's deadlines rise with its demands, what the first j demands
    take of it together is the least, for i up to j, of the supply until i's deadline and the demands after i, or else all the
    demands: a running minimum, so such keys spread over partitions. Where they don't, what a demand may take depends on what
    each earlier one has left, and the key is walked in one task.
    """
    exact = lambda df: df.filter(F.col("quantity") > 0).withColumn("_q", F.col("quantity").cast(EXACT)).drop("quantity")
    supply, demand = exact(supply), exact(demand)
    came = supply.select(key, F.col("at").alias("_t"), F.lit(0).alias("_kind"), F.col("supply_id").alias("_id"), "_q")
    due = demand.select(key, F.col("deadline").alias("_t"), F.lit(1).alias("_kind"), F.col("demand_id").alias("_id"), F.lit(0).cast(EXACT).alias("_q"))
    # Joins are stored before they are scanned, and scans go when what is made of them is stored: fewer stand on disk at a time.
    with released(supply.sparkSession) as outer:
        timed = scanned(came.unionByName(due), [key], ["_t", "_kind", "_id"], _to=("sum", "_q"))
        wanted = scanned(demand, [key], ["at", "demand_id"], _wanted=("sum", "_q"), _later=("next", "deadline"))
        back = stored(wanted.filter("_later < deadline").select(F.col(key).alias("_back")).distinct(), outer)
        walked = back.head(1)
        if walked:
            wanted = wanted.join(back, F.col(key).eqNullSafe(F.col("_back")), "left_anti")
        until = timed.filter("_kind = 1").select(F.col(key).alias("_key"), F.col("_id"), F.col("_to").alias("_supplied"))
        met = wanted.join(until, F.col(key).eqNullSafe(F.col("_key")) & (F.col("demand_id") == F.col("_id"))).withColumn("_room", F.col("_supplied") - F.col("_wanted"))
        taken = scanned(stored(met.select(key, "at", "demand_id", "_wanted", "_room")), [key], ["at", "demand_id"], _least=("min", "_room"))
        upto = taken.select(key, "at", "demand_id", (F.col("_wanted") + F.least(F.lit(0).cast(EXACT), "_least")).cast(EXACT).alias("_to"))
        # Of demands that take all until one end only the first takes anything.
        first = upto.filter("_to > 0").groupBy(key, "_to").agg(F.min(F.struct("at", "demand_id"))["demand_id"].alias("demand_id"))
        ends = timed.filter("_kind = 0").select(key, F.col("_to").cast(EXACT).alias("_to"), F.col("_id").alias("supply_id")).unionByName(first, allowMissingColumns=True)
        cuts = stored(_cuts(ends, key), outer)
    out = _served(cuts, key, F.round("allocated", 3).cast("double"))
    return out.unionByName(_walked(*(df.join(back, F.col(key).eqNullSafe(F.col("_back")), "left_semi") for df in (supply, demand)), key)) if walked else out


def _walked(supply: DataFrame, demand: DataFrame, key: str) -> DataFrame:
    schema = f"{key} {supply.schema[key].dataType.simpleString()}, supply_id long, demand_id long, allocated double"

    def walk(s: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        s, d = s.sort_values(["at", "supply_id"]), d.sort_values(["at", "demand_id"])
        left, when, ids, out = s["_q"].tolist(), s["at"].tolist(), s["supply_id"].tolist(), []
        first = 0
        for demand_id, deadline, need, own in zip(d["demand_id"], d["deadline"], d["_q"], d[key], strict=True):
            while first < len(left) and not left[first]:
                first += 1
            for i in range(first, len(left)):
                if not need or when[i] > deadline:
                    break
                part = min(left[i], need)
                if part:
                    out.append((own, ids[i], demand_id, float(round(part, 3))))
                    left[i], need = left[i] - part, need - part
        return pd.DataFrame(out, columns=[key, "supply_id", "demand_id", "allocated"])

    return supply.groupBy(key).cogroup(demand.groupBy(key)).applyInPandas(walk, schema)
