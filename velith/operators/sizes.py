"""Broadcasts only behind a check of the size; scans with fewer tasks than cores spread before heavy work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
#: What one task is dealt: bytes of text to be cut into words, rows to be sorted or hashed.
TASK_TEXT, TASK_ROWS = 8 << 20, 1_000_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` narrow rows, else as it is, to be shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def tasks(spark: SparkSession, size: int, share: int) -> int:
    """How many tasks ``size`` is dealt to, ``share`` each, and no fewer than there are cores.

    A number of its own for each step keeps a task's memory apart from the size of the input; without one, adaptive execution
    merges partitions by their compressed bytes, of which words and hash maps take many times as much.
    """
    return max(spark.sparkContext.defaultParallelism, -(-size // share))


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """A scan whose files give fewer tasks than there are cores, dealt to all of them by ``keys``; others as they are.

    A file of one row group is one task however many cores there are.  A large table has far more tasks than cores, so
    nothing is shuffled there.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, *keys) if scan.rdd.getNumPartitions() < cores else scan
