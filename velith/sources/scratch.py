"""Scratch tables and folders in the folder that all executors share.

The folder is the one that ``spark.checkpoint.dir`` names.  Where that is unset, a local master falls back on a folder of
its own, as in tests; on a cluster it is an error, since a machine's own folder would scatter a table over the nodes.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_SHARED = "/tmp/checkpoints"
_scratch: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; one of our own only on a local master that names none."""
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not found and not (conf.get("spark.master") or "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (found or LOCAL_SHARED).rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends or by :func:`clear_scratch`."""
    if not _scratch:
        atexit.register(clear_scratch, spark)
    path = f"{shared_dir(spark)}/velith-{tag}-{uuid.uuid4().hex}"
    _scratch.add(path)
    return path


def clear_scratch(spark: SparkSession) -> None:
    """Delete every scratch table of this driver.  Call it only when no result built on them is still to be read."""
    try:
        jvm = spark._jvm
        conf = spark._jsc.hadoopConfiguration()
        for path in list(_scratch):
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
            _scratch.discard(path)
    except Exception:  # the JVM may be gone when the interpreter ends; the folder is then the cluster's to clear
        _scratch.clear()


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back.

    Unlike a local checkpoint the files outlive any executor.  Each plan above runs once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
