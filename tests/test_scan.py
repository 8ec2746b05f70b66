"""Scans and allocations against plain loops, for groups that go over many partitions."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import allocation, joins
from ledgerline.operators.scan import scanned


@pytest.fixture
def partitions(spark):
    """Eight partitions, none coalesced."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


def test_scans_go_over_partitions(spark, partitions):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", None, "a", "b"]), i, rng.choice([None, rng.randint(-9, 9)])) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, at int, v long").repartition(5)
    made = scanned(df, ["g"], [F.col("at").desc()], n=("count", None), total=("sum", "v"), least=("min", "v"), seen=("last", "v"), after=("next", "at"))
    found = {(r.g, r.at): (r.n, r.total, r.least, r.seen, r.after) for r in made.collect()}
    want = {}
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: -r[1])
        for k, r in enumerate(own):
            upto = [x[2] for x in own[: k + 1] if x[2] is not None]
            want[g, r[1]] = (k + 1, sum(upto) if upto else None, min(upto, default=None), upto[-1] if upto else None, own[k + 1][1] if k + 1 < len(own) else None)
    assert found == want


def greedy(supply, demand):
    """supply: key, id, at, quantity; demand: key, id, at, deadline, quantity."""
    out, left = {}, {s[:2]: s[3] for s in supply}
    for key, demand_id, _, deadline, need in sorted(demand, key=lambda d: (d[2], d[1])):
        for k, supply_id, at, _ in sorted(supply, key=lambda s: (s[2], s[1])):
            part = min(left[k, supply_id], need)
            if k == key and at <= deadline and part > 0:
                out[key, supply_id, demand_id] = part
                left[k, supply_id] -= part
                need -= part
    return out


@pytest.mark.parametrize("rising", [True, False])
def test_deadlines_equal_the_greedy_walk(spark, partitions, rising):
    rng = random.Random(2 + rising)
    supply = [(rng.choice("aaaab"), i, rng.randint(0, 40), float(rng.randint(0, 6))) for i in range(90)]
    demand = [(rng.choice("aaaabc"), i, at := rng.randint(0, 40), at + (3 if rising else rng.randint(-5, 9)), float(rng.randint(0, 8))) for i in range(90)]
    found = allocation.fifo_with_deadline(spark.createDataFrame(supply, "k string, supply_id long, at long, quantity double"), spark.createDataFrame(demand, "k string, demand_id long, at long, deadline long, quantity double"), "k")
    assert {(r.k, r.supply_id, r.demand_id): r.allocated for r in found.collect()} == greedy(supply, demand)


def test_a_hot_key_is_many_tasks(spark, partitions):
    rows = spark.range(8000).select(F.lit("hot").alias("g"), "id", F.lit(1).alias("v"))
    spread = Counter(r.p for r in scanned(rows.repartition(3), ["g"], ["id"], total=("sum", "v")).select(F.spark_partition_id().alias("p")).collect())
    assert len(spread) >= 4 and max(spread.values()) < 4000


def test_events_without_a_key_have_no_state(spark, partitions):
    events = spark.createDataFrame([(k, None if k % 3 else "a", k) for k in range(60)], "id long, on string, day long").withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), F.col("day").cast("int")))
    states = spark.createDataFrame([("a", "2024-01-10", "x"), ("a", "2024-01-10", "w"), (None, "2024-01-01", "n")], "on string, began string, kind string").withColumn("began", F.col("began").cast("date"))
    found = {r.id: r.kind for r in joins.nearest_prior(events, states, ["id"], "on", "day", "began", 20, "kind").collect()}
    assert found == {k: "w" if k % 3 == 0 and 9 <= k <= 29 else None for k in range(60)}
