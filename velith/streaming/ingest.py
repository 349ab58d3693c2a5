"""Incremental ingestion: new rows or files are taken in once each, whatever breaks in between.

The file source remembers paths, so a file that is overwritten in place is not delivered again; changed files are found
by the batch plan (``plans.ingestion``), which compares hashes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from velith.operators import store
from velith.sources.snapshots import SnapshotTable


def upsert_batches(table: SnapshotTable, keys: list[str], shape: Callable[[DataFrame], DataFrame], order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: the last row a key of the batch replaces the table's.  Running a batch twice changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        new = store.last_wins(shape(batch), keys, order)
        table.change(lambda old: store.upsert(old, new, keys), touched=new if table.key in keys else None)

    return write


def append_batches(table: SnapshotTable, keys: list[str], shape: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: all rows of the keys in the batch are replaced by what ``shape`` makes of them."""

    def write(batch: DataFrame, _: int) -> None:
        table.change(lambda old: store.replace_groups(old, shape(batch), keys), touched=batch if table.key in keys else None)

    return write


def run_available(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Everything that has arrived, in bounded batches, then stop."""
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def parquet_stream(spark: SparkSession, path: str, schema: str, files: int = 1000) -> DataFrame:
    """New Parquet files under a path, at most ``files`` a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def file_stream(spark: SparkSession, folder: str, pattern: str = "*.txt", files: int = 1000) -> DataFrame:
    """New files of a folder as (path, modificationTime, length, content)."""
    return spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).load(folder)
