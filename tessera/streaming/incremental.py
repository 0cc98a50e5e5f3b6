"""Incremental work as a Structured Streaming query: new files are chunked once, whatever restarts in between."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import chunking



def new_documents(spark: SparkSession, folder: str, schema: str, *, files: int | None = None) -> DataFrame:
    """Parquet files that were not seen before; ``files`` bounds how many a batch takes."""
    reader = spark.readStream.schema(schema)
    return (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(folder)


def process_new(stream: DataFrame, work: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Append ``work`` of every new batch to ``target`` and stop when there's nothing new.

    A batch is written to a folder of its own number, overwritten if it runs again, so that a restart repeats nothing.
    """

    def batch(rows: DataFrame, number: int) -> None:
        work(rows).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def chunk_new(spark: SparkSession, folder: str, schema: str, target: str, checkpoint: str, *, text: str = "text") -> StreamingQuery:
    """Fixed windows of every document that wasn't chunked before."""
    return process_new(new_documents(spark, folder, schema), lambda rows: chunking.fixed(rows, text), target, checkpoint)


def read_processed(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target).drop("batch")



