"""Consuming an append-only directory of events with a cursor."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def consume(spark: SparkSession, directory: str, schema: StructType, checkpoint: str, handle: Callable[[DataFrame, int], None], files: int = 100) -> None:
    """Give ``handle`` every event file once, in bounded batches, and stop when all are read. The checkpoint is the
    cursor; a batch that failed comes again under the same number, so ``handle`` must be idempotent by number."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(directory)
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def collected(spark: SparkSession, directory: str, schema: StructType, checkpoint: str, out: str) -> DataFrame:
    """All events of the directory as a table, read through the stream. A repeated batch replaces its own files."""

    def handle(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    consume(spark, directory, schema, checkpoint, handle)
    return spark.read.option("basePath", out).parquet(f"{out}/batch=*").drop("batch")
