"""Joins that keep the child's rows, and joins without an equality that Spark would plan as nested loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scan import scanned


def matched(child: DataFrame, parent: DataFrame, on: dict[str, str], flag: str, take: list[str] = ()) -> DataFrame:
    """``child`` with ``take`` of its parent and whether it has one. The parent is made unique first, so no row is gained."""
    keys = [F.col(p).alias(f"_k{i}") for i, p in enumerate(on.values())]
    one = parent.groupBy(*keys).agg(F.lit(True).alias("_hit"), *(F.min(c).alias(c) for c in take))
    condition = [child[c] == one[f"_k{i}"] for i, c in enumerate(on)]
    return child.join(one, condition, "left").select(*(child[c] for c in child.columns), *take, F.coalesce("_hit", F.lit(False)).alias(flag))


def key_in_either(left: DataFrame, right: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Rows of ``left`` with the rows of ``right`` whose ``key`` is any of ``columns``, once each: an equi-join on the exploded keys."""
    exploded = left.withColumn("_key", F.explode(F.array_distinct(F.array(*(F.col(c) for c in columns)))))
    return exploded.join(right, exploded["_key"] == right[key]).drop("_key")


def nearest_prior(events: DataFrame, states: DataFrame, event_keys: list[str], on: str, event_time: str, state_time: str, within_days: int, tie: str) -> DataFrame:
    """Each event with the state of the same ``on`` that began last, at most ``within_days`` before it; null if none.

    ``event_keys`` identify an event; of states at one distance the smallest ``tie`` is taken. An event without ``on`` has no
    state, and the events of one ``on`` spread over partitions.
    """
    # States and events stand in one order by time, and each event looks back to the last state: nothing is multiplied.
    # A state of the same moment comes before the event; of states of one moment the smallest ``tie`` is kept.
    own = [c for c in states.columns if c != on]
    first = states.filter(F.col(on).isNotNull()).groupBy(on, state_time).agg(F.min(F.struct(tie, *(c for c in own if c != tie))).alias("_s"))
    rows = events.select(F.col(on).alias("_on"), F.col(event_time).alias("_at"), F.lit(1).alias("_kind"), F.struct(*event_keys).alias("_key"), F.struct(*events.columns).alias("_e"))
    keyed = rows.filter("_on is not null").unionByName(first.select(F.col(on).alias("_on"), F.col(state_time).alias("_at"), F.lit(0).alias("_kind"), F.struct(F.col(state_time).alias("_t"), "_s").alias("_state")), allowMissingColumns=True)
    met = scanned(keyed, ["_on"], ["_at", "_kind", "_key"], _last=("last", "_state")).filter("_kind = 1")
    near = F.col("_last._t") >= F.col("_at") - F.expr(f"INTERVAL {within_days} DAYS")
    named = lambda c: F.col("_last._t") if c == state_time else F.col(f"_last._s.{c}")
    found = met.select("_e.*", *(F.when(near, named(c)).alias(c) for c in own))
    return found.unionByName(rows.filter("_on is null").select("_e.*", *(F.lit(None).cast(states.schema[c].dataType).alias(c) for c in own)))


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join by ``key``; a key that either side repeats is an error, raised before a row is joined."""
    for side, df in (("left", left), ("right", right)):
        again = df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").first()
        if again:
            raise ValueError(f"{side}: {key} {again[key]} stands {again['n']} times")
    return left.join(right, key)


def first_by(df: DataFrame, keys: list[str], order: list[Column | str], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def repeats(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """``df`` with is_repeat: all but the first of each group in ``order``."""
    return df.withColumn("is_repeat", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1)


def full_outer(frames: list[DataFrame], key: str) -> DataFrame:
    """Full outer join of frames that are unique by ``key``."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, key, "full")
    return out
