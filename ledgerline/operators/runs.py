"""Ingest from extracts to published tables: lineage of every rule, one register of rejected rows, balance of every file."""

from __future__ import annotations

import secrets
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.contracts import TableContract
from ..sources.publish import append_history, publish
from ..sources.raw import read_raw
from . import staging

#: What happens before the staging rules. Fixed values.
RAW_RULES = {"RAW-01": "records received", "RAW-02": "record with another number of cells than declared"}


def run_id() -> str:
    """Sorts by time; the random end keeps runs of one second apart."""
    return f"{datetime.now(UTC):%Y%m%dT%H%M%SZ}-{secrets.token_hex(3)}"


def balance(received: DataFrame, staged: DataFrame, rejected: DataFrame, core: DataFrame | None = None) -> DataFrame:
    """_source_file, received, staged, quarantined, core and balanced of each file: received = staged + quarantined, core = staged.

    ``received`` has _source_file and data_lines; the others are rows with _source_file. Without ``core`` staged rows are
    their own. A file of which nothing was staged or rejected has zeros, and one that nobody received has no data lines.
    """
    counted = lambda df, name: df.groupBy("_source_file").agg(F.count("*").alias(name))
    sides = [received.select("_source_file", F.col("data_lines").alias("received")), counted(staged, "staged"), counted(rejected, "quarantined"), counted(staged if core is None else core, "core")]
    joined = reduce(lambda out, side: out.join(side, "_source_file", "full"), sides).na.fill(0)
    return joined.withColumn("balanced", (F.col("received") == F.col("staged") + F.col("quarantined")) & (F.col("core") == F.col("staged")))


def assert_files_balanced(balances: DataFrame) -> None:
    wrong = balances.filter("not balanced").orderBy("_source_file").first()
    if wrong:
        raise AssertionError(f"{wrong['_source_file']}: {wrong['received']} rows received, {wrong['staged']} staged, {wrong['quarantined']} quarantined, {wrong['core']} in core")


def raw_lineage(good: DataFrame, ragged: DataFrame) -> DataFrame:
    """The steps before staging, of the same columns as staging.lineage."""
    counts = good.agg(F.count("*").alias("good")).crossJoin(ragged.agg(F.count("*").alias("bad")))  # one row each
    steps = F.array(*(F.struct(F.lit(i).alias("step"), F.lit(r).alias("rule"), F.lit(t).alias("rule_text")) for i, (r, t) in enumerate(RAW_RULES.items(), 1)))
    each = counts.select("good", "bad", F.explode(steps).alias("s"))
    lost = F.when(F.col("s.rule") == "RAW-02", F.col("bad")).otherwise(F.lit(0).cast("long"))
    return each.select("s.*", (F.col("good") + F.col("bad")).alias("rows_in"), (F.col("good") + F.col("bad") - lost).alias("rows_out"), lost.alias("rows_rejected"))


def run_ingest(spark: SparkSession, root: str, extracts: dict[str, TableContract], run: str | None = None) -> str:
    """Reads, judges and publishes the extracts (path to contract) as one run and gives its id.

    Published are each table under its own name, ``quarantine``, ``lineage`` and ``files``. What was written is verified
    before the pointer moves: a file out of balance raises AssertionError, the last run stays published, and the run log
    under ``history/runs`` says ``unbalanced``.
    """
    run = run or run_id()
    tables, rejected, steps, files = {}, [], [], []
    for path, contract in extracts.items():
        good, ragged, sources = read_raw(spark, path, contract)
        judged = staging.judge(good, contract)
        tables[contract.table] = staging.staged(judged, contract).withColumn("_run_id", F.lit(run))
        short = ragged.select("_source_file", "_source_row", F.lit("RAW-02").alias("rule"), F.lit(None).cast("string").alias("failing_column"), F.lit(None).cast("string").alias("received_value"), F.to_json("fields").alias("record"), F.lit("open").alias("status"))
        bad = staging.quarantine(judged).unionByName(short)
        rejected.append(bad.select(F.when(F.col("rule") == "RAW-02", "raw").otherwise("staging").alias("layer"), F.lit(contract.system).alias("system"), F.lit(contract.table).alias("table"), "*"))
        later = staging.lineage(judged).withColumn("step", F.col("step") + len(RAW_RULES))
        steps.append(raw_lineage(good, ragged).unionByName(later).select(F.lit(contract.table).alias("table"), "*"))
        files.append(sources.select(F.lit(contract.table).alias("table"), F.col("file").alias("_source_file"), F.col("rows_received").alias("data_lines")))
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    quarantine = staging.identified(union(rejected), ["table", "_source_file", "_source_row"], "Q", 6, "quarantine_id")
    log = {"status": "succeeded"}

    def verify(written: dict[str, DataFrame]) -> None:
        kept = union([written[name].select(F.lit(name).alias("table"), "_source_file") for name in tables])
        sums = balance(written["files"], kept, written["quarantine"])
        log.update({k: v or 0 for k, v in sums.agg(*(F.sum(c).alias(c) for c in ("received", "staged", "quarantined"))).first().asDict().items()})
        try:
            assert_files_balanced(sums)
        except AssertionError:
            log["status"] = "unbalanced"
            raise

    try:
        publish(spark, root, run, {**tables, "quarantine": quarantine, "lineage": union(steps), "files": union(files)}, verify)
    finally:
        if "received" in log:
            row = [(run, log["status"], log["received"], log["staged"], log["quarantined"])]
            append_history(spark.createDataFrame(row, "run_id string, status string, received long, staged long, quarantined long"), root, "runs", run)
    return run
