"""Changes to keyed tables as DataFrame algebra: upsert, replace, delete, mark, prune.

Each takes the old table and the change and returns the new table; a snapshot writer (``sources.snapshots``) makes it
durable.  Keys meet by hash join; nothing is collected.  Null keys never match and are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velith.operators.sizes import TASK_ROWS, bounded, tasks


def last_wins(rows: DataFrame, keys: list[str], order: str | Column) -> DataFrame:
    """One row a key: the last by ``order``."""
    by = F.col(order) if isinstance(order, str) else order
    nth = Window.partitionBy(*keys).orderBy(by.desc())
    return rows.withColumn("_velith_nth", F.row_number().over(nth)).filter("_velith_nth = 1").drop("_velith_nth")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with equal keys; columns in ``keep`` stay as they were first written."""
    kept = old.join(new.select(*keys), keys, "left_anti").select(*old.columns)
    first = old.select(*keys, *(F.col(c).alias(f"_old_{c}") for c in keep))
    changed = new.join(first, keys, "left") if keep else new
    return kept.unionByName(changed.select(*(F.coalesce(f"_old_{c}", c).alias(c) if c in keep else F.col(c) for c in old.columns)))


def replace_groups(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of the groups that ``new`` has rows of are replaced by its rows."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def without(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``gone``.

    Keys too many to broadcast are dealt by the number of rows, and the table's rows follow them, so a task's sort doesn't
    grow with the table.
    """
    keys = bounded(gone.select(key))
    if "broadcast" not in keys._jdf.queryExecution().logical().toString():
        spark = table.sparkSession
        parts = max(tasks(spark, table.count(), TASK_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))
        keys = keys.repartition(parts, key)
    return table.join(keys, key, "left_anti").select(*table.columns)


def delete_cascade(gone: DataFrame, key: str, *tables: DataFrame) -> tuple[DataFrame, ...]:
    """Each table without the rows of the keys in ``gone``."""
    return tuple(without(t, gone, key) for t in tables)


def mark(table: DataFrame, keys: DataFrame, key: str, column: str, value: Column) -> DataFrame:
    """``column`` set to ``value`` on the rows whose key is in ``keys``."""
    hit = keys.select(key).distinct().withColumn("_velith_hit", F.lit(True))
    joined = table.join(hit, key, "left")
    return joined.withColumn(column, F.when(F.col("_velith_hit"), value).otherwise(F.col(column))).select(*table.columns)


def prune(points: DataFrame, valid: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(points whose key is valid, points to remove)"""
    return points.join(valid.select(key), key, "left_semi"), points.join(valid.select(key), key, "left_anti")


def pending(chunks: DataFrame, strategy: str | None = None) -> DataFrame:
    """Chunks without a vector yet, of one strategy if it is named."""
    own = chunks if strategy is None else chunks.filter(F.col("strategy") == strategy)
    return own.filter(~F.coalesce("embedded", F.lit(False)))
