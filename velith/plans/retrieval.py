"""Retrieval for a whole table of questions in one plan: variants, two searches, fusion, confidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velith.functions import lexicon as lx
from velith.operators import bm25, dense, fusion

Encoder = Callable[[Column], Column]


def sparse_hits(index: bm25.Index, questions: DataFrame, key: str, limit: int = lx.CANDIDATES, expand: bool = True, count: int = lx.VARIANTS, text_col: str = "text", within: DataFrame | None = None) -> DataFrame:
    """(key, rank, id, score) over a question's variants, of the ids in ``within`` if that is given."""
    if not expand:
        return bm25.search(index, questions, limit, [key], text_col, within)
    asked = fusion.variants(questions, key, text_col, count)
    return fusion.merge_variants(bm25.search(index, asked, limit, [key, "variant"], within=within), key, limit)


def dense_hits(vectors: DataFrame, questions: DataFrame, key: str, limit: int = lx.CANDIDATES, metric: str = "cosine", only: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(key, rank, id, score); ``only`` filters the vectors before any is scored."""
    own = vectors if only is None else vectors.filter(only)
    return dense.top_k(own, questions, limit, metric, id_col, key, vector_col)


def dense_variants(vectors: DataFrame, questions: DataFrame, encode: Encoder, key: str, limit: int = lx.CANDIDATES, count: int = lx.VARIANTS, text_col: str = "text", metric: str = "cosine", expand: bool = True, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(key, rank, id, score) over a question's variants, each encoded."""
    asked = fusion.variants(questions, key, text_col, count if expand else 0)
    numbered = asked.select(F.to_json(F.struct(F.col(key).alias("k"), F.col("variant").alias("v"))).alias("_velith_q"), encode(F.col("text")).alias(vector_col))
    hits = dense.top_k(vectors, numbered, limit, metric, id_col, "_velith_q", vector_col)
    back = F.from_json("_velith_q", f"k {questions.schema[key].dataType.simpleString()}, v int")
    split = hits.withColumn("_velith_q", back).select(F.col("_velith_q.k").alias(key), F.col("_velith_q.v").alias("variant"), "rank", "id", "score")
    return fusion.merge_variants(split, key, limit)


def retrieve(mode: str, key: str, top_k: int = lx.TOP_K, dense_list: DataFrame | None = None, sparse_list: DataFrame | None = None) -> DataFrame:
    """Final results of a mode from its candidate lists."""
    if mode == "hybrid":
        return fusion.merge_results(dense_list, sparse_list, key, top_k)
    if mode not in ("dense", "sparse"):
        raise ValueError(f"unknown mode {mode!r}; there are dense, sparse and hybrid")
    return fusion.single(dense_list if mode == "dense" else sparse_list, key, mode, top_k)


def overridden(results: DataFrame, records: DataFrame, payload: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """Results with ``columns``: the stored record's value, or where that is null, empty or 0 the one kept with the vector."""
    side = lambda df, tag: df.select(F.col(key).alias("_velith_id"), *(F.col(c).alias(f"_{tag}_{c}") for c in columns if c in df.columns))
    joined = results
    for df, tag in ((records, "r"), (payload, "p")):
        joined = joined.join(side(df, tag), F.col(key) == F.col("_velith_id"), "left").drop("_velith_id")

    def value(c: str) -> Column:
        own, sent = (F.col(f"_{tag}_{c}") if c in df.columns else F.lit(None) for df, tag in ((records, "r"), (payload, "p")))
        empty = {"string": F.lit(""), "int": F.lit(0), "bigint": F.lit(0)}.get(records.schema[c].dataType.simpleString())
        return F.coalesce(own if empty is None else F.nullif(own, empty), sent, own)

    return joined.select(*results.columns, *(value(c).alias(c) for c in columns))


def search_chunks(chunks: DataFrame, points: DataFrame, questions: DataFrame, key: str, encode: Encoder | None, mode: str = "hybrid", strategy: str = "sentence", top_k: int = lx.TOP_K, doc_ids: list[str] | None = None, category: str | None = None, expand: bool = True, limit: int = lx.CANDIDATES, text_col: str = "text", index: bm25.Index | None = None) -> DataFrame:
    """What a knowledge base holds for a table of questions: (key, rank, id, score, retriever, dense_rank, ..., sparse_score).

    ``chunks`` has chunk_id, doc_id, strategy, text and, for a category, category; ``points`` has chunk_id, doc_id, strategy and
    vector.  Filters on documents apply to both retrievers before anything is scored; term weights are those of the whole
    strategy.  ``index`` is that strategy's BM25 index if there is one already.
    """
    if mode not in ("dense", "sparse", "hybrid"):
        raise ValueError(f"unknown mode {mode!r}; there are dense, sparse and hybrid")
    own = chunks.filter(F.col("strategy") == strategy)
    chosen = F.lit(True)
    if doc_ids is not None:
        chosen = chosen & F.col("doc_id").isin(doc_ids)
    if category is not None:
        chosen = chosen & (F.col("category") == category)
    filtered = doc_ids is not None or category is not None
    found: dict[str, DataFrame | None] = {"dense_list": None, "sparse_list": None}
    if mode != "dense":
        within = own.filter(chosen).select(F.col("chunk_id").alias("id")) if filtered else None
        found["sparse_list"] = sparse_hits(index or bm25.build(own, "chunk_id", "text"), questions, key, limit, expand, text_col=text_col, within=within)
    if mode != "sparse":
        if encode is None:
            raise ValueError("dense search needs an encoder")
        vectors = points.filter(F.col("strategy") == strategy)
        if filtered:
            vectors = vectors.join(own.filter(chosen).select("chunk_id"), "chunk_id", "left_semi")
        found["dense_list"] = dense_variants(vectors, questions, encode, key, limit, text_col=text_col, expand=expand, id_col="chunk_id", vector_col="vector")
    return retrieve(mode, key, top_k, **found)
