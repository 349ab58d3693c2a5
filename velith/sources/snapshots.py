"""Tables as numbered snapshots over shared data folders.

A snapshot is one entry in the table's log: the list of the folders that make it up.  Data is written first, to a folder of its
own; the entry is then created exclusively under the next number, so of two writers that started from the same snapshot one
gets the number and the other a :class:`Conflict`, after which :meth:`SnapshotTable.change` starts over from the new
snapshot.  A writer that dies leaves a folder that no entry names; one that dies between its claim of a number and the
entry leaves the claim, a file that is to be removed by hand.

A table with a key is cut into buckets by the key's hash.  A change that names the keys it touches reads and writes only
their buckets, an append writes only its rows; everything else is taken over by name.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has made the snapshot that this one was about to make."""


class SnapshotTable:
    """A table at ``path`` with a fixed schema; ``key`` is the column whose hash deals rows to ``buckets``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, partition_by: tuple[str, ...] = (), key: str | None = None, buckets: int = 64):
        self.spark, self.path, self.schema, self.partition_by, self.key, self.buckets = spark, path.rstrip("/"), schema, partition_by, key, buckets

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _entry(self, number: int) -> list[dict]:
        """The parts of a snapshot: folder and bucket (null where the table is whole or was appended to)."""
        stream = self._fs().open(self._path(f"_log/{number}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def versions(self) -> list[int]:
        """Numbers of whole snapshots, ascending."""
        fs = self._fs()
        if not fs.exists(self._path("_log")):
            return []
        found = [(s.getPath().getName(), s.getLen()) for s in fs.listStatus(self._path("_log"))]
        return sorted(int(name) for name, size in found if name.isdigit() and size > 0)

    def _read(self, parts: list[dict]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        names = self.spark.createDataFrame([], self.schema).columns
        by_folder: dict[str, list[int | None]] = {}
        for part in parts:
            by_folder.setdefault(part["folder"], []).append(part["bucket"])
        kind = self.schema + (", _bucket int" if self.key else "")
        frames = []
        for folder, own in by_folder.items():
            rows = self.spark.read.schema(kind).parquet(f"{self.path}/{folder}")
            frames.append((rows if own == [None] else rows.filter(F.col("_bucket").isin(own))).select(*names))
        return reduce(DataFrame.unionByName, frames)

    def read(self, version: int | None = None) -> DataFrame:
        """The newest snapshot or one by number; an empty frame where there is none."""
        found = self.versions()
        return self._read(self._entry(found[-1] if version is None else version) if found else [])

    def _save(self, rows: DataFrame) -> list[dict]:
        """Rows in a folder of their own, as parts of a snapshot."""
        folder = f"data-{uuid.uuid4().hex}"
        columns = self.spark.createDataFrame([], self.schema).columns
        rows, by = rows.select(*columns), self.partition_by
        if self.key:
            rows, by = rows.withColumn("_bucket", self._bucket(F.col(self.key))).repartition("_bucket"), ("_bucket", *by)
        rows.write.partitionBy(*by).parquet(f"{self.path}/{folder}")
        if not self.key:
            return [{"folder": folder, "bucket": None}]
        fs = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(self._path(folder))]
        return [{"folder": folder, "bucket": int(n.removeprefix("_bucket="))} for n in names if n.startswith("_bucket=") and n[8:].isdigit()]

    def _bucket(self, value):
        return F.pmod(F.xxhash64(value.cast("string")), F.lit(self.buckets)).cast("int")

    def _commit(self, base: int, parts: list[dict]) -> int:
        """Name the parts as the snapshot after ``base``."""
        fs, name = self._fs(), self._path(f"_log/{base + 1}")
        fs.mkdirs(self._path("_log"))
        if fs.exists(name) or not fs.createNewFile(self._path(f"_log/{base + 1}.claim")):
            raise Conflict(f"snapshot {base + 1} of {self.path} is another writer's")
        stream = fs.create(name, False)
        stream.write(bytearray(json.dumps(parts).encode()))
        stream.close()
        return base + 1

    def _base(self) -> tuple[int, list[dict]]:
        found = self.versions()
        return (found[-1], self._entry(found[-1])) if found else (0, [])

    def write(self, rows: DataFrame) -> int:
        """A new snapshot of these rows alone; returns its number."""
        base, _ = self._base()
        return self._commit(base, self._save(rows))

    def append(self, rows: DataFrame, attempts: int = 5) -> int:
        """A new snapshot with these rows besides the old ones, which aren't touched."""
        return self._retried(lambda old: (old, self._save(rows)), attempts)

    def change(self, how: Callable[[DataFrame], DataFrame], touched: DataFrame | None = None, attempts: int = 5) -> int:
        """A new snapshot made from the newest one; ``touched`` holds the keys that may change, if they are known."""
        if touched is None or not self.key:
            return self._retried(lambda old: ([], self._save(how(self._read(old)))), attempts)
        hit = {r["b"] for r in touched.select(self._bucket(F.col(self.key)).alias("b")).distinct().collect()}  # at most ``buckets``

        def make(old: list[dict]):
            return [p for p in old if p["bucket"] not in hit], self._save(how(self._read([p for p in old if p["bucket"] in hit])).filter(self._bucket(F.col(self.key)).isin(hit)))

        return self._retried(make, attempts)

    def _retried(self, make: Callable[[list[dict]], tuple[list[dict], list[dict]]], attempts: int) -> int:
        for attempt in range(attempts):
            base, old = self._base()
            kept, new = make(old)
            try:
                return self._commit(base, kept + new)
            except Conflict:
                if attempt + 1 == attempts:
                    raise
        raise ValueError("at least one attempt is needed")

    def vacuum(self, keep: int = 2) -> None:
        """Delete all but the newest ``keep`` snapshots and the folders that only those named."""
        found = self.versions()
        gone, kept = found[: -keep or None], found[len(found) - keep :] if keep else []
        used = {p["folder"] for n in kept for p in self._entry(n)}
        fs = self._fs()
        for number in gone:
            for folder in {p["folder"] for p in self._entry(number)} - used:
                fs.delete(self._path(folder), True)
            fs.delete(self._path(f"_log/{number}"), False)
