"""Evaluation of answers: verdicts to metrics, samples to summaries, summaries to a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velith.functions.text import col
from velith.functions.vectors import cosine


def share(verdict: Column | str) -> Column:
    """Aggregate: share of true among the decided verdicts, to four decimals; null if none is decided."""
    return F.round(F.avg(col(verdict).cast("int")), 4)


def relevancy(a: Column | str, b: Column | str) -> Column:
    """Cosine of question and reconstructed question, not below 0, to four decimals."""
    near = cosine(a, b)
    return F.when(near.isNotNull(), F.round(F.greatest(F.lit(0.0), near), 4))


def recall_fraction(attributable: Column | str, total: Column | str) -> Column:
    """Attributable statements over all, between 0 and 1; null without a statement."""
    part = col(attributable).cast("double") / F.when(col(total) > 0, col(total).cast("double"))
    return F.when(part.isNotNull(), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), part)), 4))


def hit(expected: Column | str, retrieved: Column | str) -> Column:
    """Whether an expected document is among those retrieved; null where none is expected."""
    return F.when(F.size(col(expected)) > 0, F.arrays_overlap(col(expected), col(retrieved)))


def refusal_correct(answerable: Column | str, refused: Column | str) -> Column:
    return F.when(col(answerable), ~col(refused)).otherwise(col(refused))


def summary(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: questions, retrieval_hit_rate, refusal_accuracy, citation_rate (answerable ones), avg_confidence, avg_latency_ms."""
    rate = lambda c: F.round(F.avg(c.cast("int")), 4)
    return samples.groupBy(*keys).agg(
        F.count("*").alias("questions"),
        rate(F.col("hit")).alias("retrieval_hit_rate"),
        rate(refusal_correct("answerable", "refused")).alias("refusal_accuracy"),
        rate(F.when(F.col("answerable"), F.col("cited"))).alias("citation_rate"),
        F.round(F.avg("confidence"), 4).alias("avg_confidence"),
        F.round(F.avg("latency_ms"), 0).cast("long").alias("avg_latency_ms"),
    )


def aggregate(scores: DataFrame, keys: list[str], metrics: tuple[str, ...] = ("faithfulness", "answer_relevancy", "context_precision", "context_recall")) -> DataFrame:
    """Per key the mean of each metric over the samples that have it, to four decimals."""
    return scores.groupBy(*keys).agg(*(F.round(F.avg(m), 4).alias(m) for m in metrics))


TABLE = {
    True: {"retrieval_hit_rate": "Hit rate", "refusal_accuracy": "Refusals right", "avg_confidence": "Confidence", "avg_latency_ms": "Latency"},
    False: {"faithfulness": "Faithful", "answer_relevancy": "Relevant", "context_precision": "Precision", "context_recall": "Recall", "retrieval_hit_rate": "Hit rate", "refusal_accuracy": "Refusals right", "citation_rate": "Cited", "avg_latency_ms": "Latency"},
}


def table_row(summary_: DataFrame, retrieval_only: bool = False) -> Column:
    """A Markdown row of a summary: shares to three decimals, counts with thousands marks, n/a for null."""

    def cell(name: str) -> Column:
        kind = summary_.schema[name].dataType.simpleString()
        value = F.format_string("%.3f", F.col(name)) if kind == "double" else F.format_number(name, 0)
        unit = " ms" if name == "avg_latency_ms" else ""
        return F.concat(F.coalesce(value, F.lit("n/a")), F.lit(unit))

    return F.concat(F.lit("| "), F.concat_ws(" | ", "strategy", "mode", *(cell(c) for c in TABLE[retrieval_only])), F.lit(" |"))


def format_table(summary_: DataFrame, retrieval_only: bool = False) -> str:
    """The Markdown table of a summary; it has one row a strategy and mode, which is all that reaches the driver."""
    names = ["Strategy", "Retrieval", *TABLE[retrieval_only].values()]
    rows = summary_.orderBy("strategy", "mode").select(table_row(summary_, retrieval_only).alias("row")).collect()
    return "\n".join(["| " + " | ".join(names) + " |", "|" + "---|" * len(names), *(r["row"] for r in rows)])
