"""Summaries of the knowledge base, the logs and the runs: one aggregate each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Per strategy: chunks, embedded, documents, avg_tokens, min_tokens, max_tokens."""
    return chunks.groupBy("strategy").agg(
        F.count("*").alias("chunks"),
        F.count_if("embedded").alias("embedded"),
        F.countDistinct("doc_id").alias("documents"),
        F.round(F.avg("token_count"), 0).alias("avg_tokens"),
        F.min("token_count").alias("min_tokens"),
        F.max("token_count").alias("max_tokens"),
    )


def knowledge_base(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with embedded_chunks and total_chunks; chunks are counted before they meet their documents."""
    counts = chunks.groupBy("doc_id").agg(F.count(F.when(F.col("embedded"), F.col("chunk_id"))).alias("e"), F.count("chunk_id").alias("t"))
    zero = F.lit(0).cast("long")
    return documents.join(counts, "doc_id", "left").select(*documents.columns, F.coalesce("e", zero).alias("embedded_chunks"), F.coalesce("t", zero).alias("total_chunks"))


def knowledge_totals(base: DataFrame) -> DataFrame:
    """Documents, chunks and embedded chunks over the whole knowledge base."""
    return base.agg(F.count("*").alias("documents"), F.coalesce(F.sum("total_chunks"), F.lit(0)).cast("long").alias("chunks"), F.coalesce(F.sum("embedded_chunks"), F.lit(0)).cast("long").alias("embedded"))


def evaluation_summary(results: DataFrame) -> DataFrame:
    """Per run, strategy and mode: questions, mean metrics to four decimals, mean latency to the millisecond; nulls don't count."""
    metrics = ["faithfulness", "answer_relevancy", "context_precision", "context_recall"]
    return results.groupBy("run_label", "strategy", "retrieval_mode").agg(F.count("*").alias("questions"), *(F.round(F.avg(m), 4).alias(m) for m in metrics), F.round(F.avg("latency_ms"), 0).alias("avg_latency_ms"))


def query_stats(log: DataFrame) -> DataFrame:
    """Total, refused, avg_confidence (three decimals) and avg_latency_ms of a query log."""
    return log.agg(F.count("*").alias("total"), F.count_if("refused").alias("refused"), F.round(F.avg("confidence"), 3).alias("avg_confidence"), F.round(F.avg("latency_ms"), 0).alias("avg_latency_ms"))


def has_all_chunks(documents: DataFrame, chunks: DataFrame, strategies: list[str]) -> DataFrame:
    """(doc_id, complete): whether a document has chunks of every strategy asked for."""
    found = chunks.filter(F.col("strategy").isin(strategies)).groupBy("doc_id").agg(F.countDistinct("strategy").alias("n"))
    return documents.select("doc_id").join(found, "doc_id", "left").select("doc_id", (F.coalesce("n", F.lit(0)) == len(strategies)).alias("complete"))


def document_totals(pages: DataFrame) -> DataFrame:
    """(doc_id, page_count, char_count, table_count)"""
    return pages.groupBy("doc_id").agg(F.count("*").alias("page_count"), F.sum(F.length("text")).alias("char_count"), F.sum("table_count").alias("table_count"))


def ingest_status(files: DataFrame, known: DataFrame, complete: DataFrame) -> DataFrame:
    """(doc_id, status): new, changed (other hash, or chunks missing) or skipped, before anything is parsed."""
    joined = files.select("doc_id", "content_hash").join(known.select("doc_id", F.col("content_hash").alias("old")), "doc_id", "left").join(complete, "doc_id", "left")
    same = (F.col("old") == F.col("content_hash")) & F.coalesce("complete", F.lit(False))
    return joined.select("doc_id", F.when(F.col("old").isNull(), "new").when(same, "skipped").otherwise("changed").alias("status"))


def ingest_counters(status: DataFrame) -> DataFrame:
    """seen, new, changed, skipped"""
    return status.agg(F.count("*").alias("seen"), *(F.count_if(F.col("status") == s).alias(s) for s in ("new", "changed", "skipped")))


def health(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the worst status of its parts: down, degraded or ok."""
    severity: Column = F.when(F.col("status") == "down", 2).when(F.col("status") == "degraded", 1).otherwise(0)
    worst = F.max(severity)
    return parts.groupBy(*keys).agg(F.when(worst == 2, "down").when(worst == 1, "degraded").otherwise("ok").alias("status"))
