"""Merging ranked lists: variants of a question, reciprocal rank fusion, labels and confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velith.functions import lexicon as lx
from velith.functions.answers import confidence, expansions


def variants(questions: DataFrame, key: str, text_col: str = "text", count: int = lx.VARIANTS) -> DataFrame:
    """(key, variant, text): each question as variant 0 and its rewritings."""
    every = F.concat(F.array(F.col(text_col)), expansions(text_col, count))
    return questions.select(key, F.posexplode(every).alias("variant", "text"))


def merge_variants(hits: DataFrame, key: str, limit: int = lx.CANDIDATES) -> DataFrame:
    """(key, rank, id, score) from hits with a variant: the first variant that finds an id gives its score."""
    first = Window.partitionBy(key, "id").orderBy("variant", "rank")
    once = hits.withColumn("nth", F.row_number().over(first)).filter("nth = 1")
    order = Window.partitionBy(key).orderBy(F.col("score").desc(), "variant", "rank")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select(key, "rank", "id", "score")


def rrf(lists: list[DataFrame], key: str, k: int = lx.RRF_K, weights: list[float] | None = None) -> DataFrame:
    """(key, rank, id, score): sum of weight / (k + rank) over the lists, ties by id.  One shuffle for any number of lists."""
    weights = weights or [1.0] * len(lists)
    if len(weights) != len(lists):
        raise ValueError("one weight a list is needed")
    parts = [df.select(key, "id", (F.lit(float(w)) / (F.lit(float(k)) + F.col("rank"))).alias("part")) for df, w in zip(lists, weights, strict=True)]
    summed = reduce(DataFrame.union, parts).groupBy(key, "id").agg(F.round(F.sum("part"), 9).alias("score"))
    order = Window.partitionBy(key).orderBy(F.col("score").desc(), "id")
    return summed.withColumn("rank", F.row_number().over(order)).select(key, "rank", "id", "score")


def merge_results(dense: DataFrame, sparse: DataFrame, key: str, top_k: int = lx.TOP_K, k: int = lx.RRF_K, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """(key, rank, id, score, retriever, dense_rank, dense_score, sparse_rank, sparse_score): an outer merge as one aggregate."""
    side = lambda df, name: df.select(key, "id", F.lit(name).alias("side"), "rank", "score")
    pick = lambda name, c: F.max(F.when(F.col("side") == name, F.col(c)))
    merged = side(dense, "dense").union(side(sparse, "sparse")).groupBy(key, "id").agg(*(pick(s, c).alias(f"{s}_{c}") for s in ("dense", "sparse") for c in ("rank", "score")))
    part = lambda s, w: F.coalesce(F.lit(float(w)) / (F.lit(float(k)) + F.col(f"{s}_rank")), F.lit(0.0))
    scored = merged.withColumn("score", F.round(part("dense", weights[0]) + part("sparse", weights[1]), 9))
    order = Window.partitionBy(key).orderBy(F.col("score").desc(), "id")
    label = F.when(F.col("dense_rank").isNotNull() & F.col("sparse_rank").isNotNull(), "hybrid").when(F.col("dense_rank").isNotNull(), "dense").otherwise("sparse")
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)
    return ranked.select(key, "rank", "id", "score", label.alias("retriever"), "dense_rank", "dense_score", "sparse_rank", "sparse_score")


def single(hits: DataFrame, key: str, mode: str, top_k: int = lx.TOP_K) -> DataFrame:
    """One retriever's list in the form of :func:`merge_results`."""
    none = lambda kind: F.lit(None).cast(kind)
    own = lambda s: (F.col("rank"), F.col("score")) if s == mode else (none("int"), none("double"))
    (dr, ds), (sr, ss) = own("dense"), own("sparse")
    return hits.filter(F.col("rank") <= top_k).select(key, "rank", "id", "score", F.lit(mode).alias("retriever"), dr.alias("dense_rank"), ds.alias("dense_score"), sr.alias("sparse_rank"), ss.alias("sparse_score"))


def with_confidence(questions: DataFrame, results: DataFrame, key: str, mode: str) -> DataFrame:
    """(key, results, confidence) of every question, those that found nothing included."""
    both = F.col("dense_rank").isNotNull() & F.col("sparse_rank").isNotNull()
    found = results.groupBy(key).agg(F.count("*").alias("results"), F.max("dense_score").alias("dense"), F.max("sparse_score").alias("sparse"), F.count_if(both).alias("both"))
    joined = questions.select(key).join(found, key, "left").withColumn("results", F.coalesce("results", F.lit(0).cast("long")))
    return joined.select(key, "results", confidence(F.lit(mode), "dense", "sparse", "both", "results").alias("confidence"))


def sure(results: DataFrame, key: str, mode: str) -> DataFrame:
    """Results with ``results`` and ``confidence`` of their question, in one pass over them; questions without results have no row."""
    own = Window.partitionBy(key)
    both = F.col("dense_rank").isNotNull() & F.col("sparse_rank").isNotNull()
    counted = results.select("*", F.count("*").over(own).alias("results"), F.max("dense_score").over(own).alias("_dense"), F.max("sparse_score").over(own).alias("_sparse"), F.count_if(both).over(own).alias("_both"))
    return counted.withColumn("confidence", confidence(F.lit(mode), "_dense", "_sparse", "_both", "results")).drop("_dense", "_sparse", "_both")
