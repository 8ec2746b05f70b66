"""Incremental ingestion: files that arrive are judged by the staging chain, batch by batch, and what was read is remembered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..operators.staging import judge, quarantine, staged
from ..sources.contracts import TableContract


def ingest_available(spark: SparkSession, source: str, target: str, contract: TableContract, checkpoint: str) -> None:
    """Stages all JSON-lines files of ``source`` not read before, then stops. A batch that is retried replaces its own output.

    Duplicates and keys are judged within a batch; across batches, read the staged table through ``latest()``.
    """
    text = StructType([StructField(n, StringType()) for n in contract.names] + [StructField("_source_file", StringType()), StructField("_source_row", IntegerType())])

    def each(batch: DataFrame, number: int) -> None:
        judged = judge(batch, contract)
        staged(judged, contract).write.mode("overwrite").parquet(f"{target}/staged/batch={number}")
        quarantine(judged).write.mode("overwrite").parquet(f"{target}/quarantine/batch={number}")

    stream = spark.readStream.schema(text).json(source)
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key, of the first batch that staged it."""
    order = F.struct("batch", "_source_file", "_source_row")
    first = df.groupBy(*keys).agg(F.min(order).alias("_first"))
    return df.join(first, keys).filter(order == F.col("_first")).drop("_first")


def windowed(events: DataFrame, time: str, size: str, late: str, keys: list[str]) -> DataFrame:
    """Counts by tumbling window; events later than ``late`` behind the newest are not counted."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), *keys).agg(F.count("*").alias("n_events"))
