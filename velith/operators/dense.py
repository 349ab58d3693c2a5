"""Exact vector search: a set of query vectors against all vectors, in blocks.

The query set is cut into blocks of bounded size; each block is sent to the executors and meets every partition of the
vectors as a matrix product, of which a task keeps the best k a query.  So one row per query, task and place in the list
is shuffled, never a pair.  Of several blocks one is held at a time: its lists are written before the next one is fetched.
Filters on the vectors go below the product, into the scan.

Defined cases: ids are whole numbers or strings; null ids, null vectors and vectors of another dimension than the queries'
are skipped; a zero vector has cosine 0; scores are rounded to six decimals and ties go by id; an empty query set or table
gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velith.sources.scratch import materialise

QUERY_BLOCK, ROW_BLOCK = 4096, 1024


def scores(queries: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    """queries x rows, higher is nearer: cosine, dot product or minus the Euclidean distance."""
    if metric == "dot":
        return queries @ rows.T
    if metric == "euclid":
        squares = (queries**2).sum(axis=1)[:, None] - 2 * (queries @ rows.T) + (rows**2).sum(axis=1)
        return -np.sqrt(np.maximum(squares, 0))
    if metric != "cosine":
        raise ValueError(f"unknown metric {metric!r}; there are cosine, dot and euclid")
    size = np.outer(np.linalg.norm(queries, axis=1), np.linalg.norm(rows, axis=1))
    return np.where(size > 0, queries @ rows.T / np.where(size > 0, size, 1), 0.0)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns of each row, by score and then id."""
    order = np.lexsort((ids, -score), axis=1)[:, :k]
    return np.take_along_axis(score, order, axis=1), np.take_along_axis(ids, order, axis=1)


def _plain(df: DataFrame, name: str):
    """An id column as a whole number or a string."""
    return F.col(name).cast("string" if df.schema[name].dataType.simpleString() == "string" else "long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", id_col: str = "vec_id", query_col: str = "query_id", vector_col: str = "embedding", query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_col, rank, id, score)"""
    spark = vectors.sparkSession
    asked = queries.select(_plain(queries, query_col).alias("q"), F.col(vector_col).cast("array<double>").alias("v")).filter("q is not null and v is not null")
    blocks = max(1, -(-asked.count() // query_block))
    rows = vectors.select(_plain(vectors, id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter("id is not null and v is not null")
    kinds = {"id": rows.schema["id"].dataType.simpleString(), "q": asked.schema["q"].dataType.simpleString()}

    def near(block: int):
        own = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block)
        by_size: dict[int, list] = {}
        for q, v in sorted((r["q"], r["v"]) for r in own.collect()):
            by_size.setdefault(len(v), []).append((q, v))
        shared = spark.sparkContext.broadcast({d: (np.array([q for q, _ in x]), np.array([v for _, v in x])) for d, x in by_size.items()})

        def run(batches):
            held = {d: (np.full((len(q), 0), 0.0), None) for d, (q, _) in shared.value.items()}
            for batch in batches:
                ids, lists = np.array(batch.column(0).to_pylist(), str if kinds["id"] == "string" else np.int64), batch.column(1)
                sizes = np.diff(np.asarray(lists.offsets))
                for d, (_, matrix) in shared.value.items():
                    mine = np.flatnonzero(sizes == d)
                    for at in range(0, len(mine), ROW_BLOCK):
                        part = mine[at : at + ROW_BLOCK]
                        x = np.asarray(lists.take(pa.array(part)).flatten()).reshape(len(part), d)
                        s = np.round(scores(matrix, x, metric), 6)
                        here = np.broadcast_to(ids[part], s.shape)
                        old, old_ids = held[d]
                        held[d] = best(np.hstack([old, s]), here if old_ids is None else np.hstack([old_ids, here]), k)
            for d, (s, i) in held.items():
                if i is not None:
                    q = np.repeat(shared.value[d][0], s.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(q.tolist()), pa.array(i.ravel().tolist()), pa.array(s.ravel())], names=["q", "id", "score"])

        return rows.mapInArrow(run, f"q {kinds['q']}, id {kinds['id']}, score double"), shared

    if blocks == 1:
        found = near(0)[0]
    else:
        parts = []
        for block in range(blocks):
            lists, shared = near(block)
            parts.append(materialise(lists, "nearest"))
            shared.unpersist()
        found = reduce(DataFrame.union, parts)
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(F.col("q").alias(query_col), "rank", "id", "score")
