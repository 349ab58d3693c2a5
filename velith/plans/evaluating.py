"""Evaluation runs: questions x strategies x modes over a knowledge base, answered, judged and summed up.

A question set is a table (id, question, ground_truth, expected_docs, answerable), as ``sources.files.question_set`` reads it.
Each strategy is searched once a retriever; the three modes are made from the same two candidate lists.  Judges are column
functions (``Judge``), so a model on the executors takes the place of a stand-in without a change to the plan.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velith.functions import answers, lexicon as lx
from velith.operators import evaluation as e
from velith.operators import bm25
from velith.operators.fusion import with_confidence
from velith.plans import answering, retrieval
from velith.sources.models import overlap_judge, recall_judge
from velith.sources.scratch import materialise

METRICS = ("faithfulness", "answer_relevancy", "context_precision", "context_recall")
CELL = ["strategy", "mode"]
Encoder = Callable[[Column], Column]


@dataclass(frozen=True)
class Judge:
    """Verdicts as column functions; null is an undecided verdict and counts neither way."""

    claims: Callable[[Column], Column] = answers.claims
    supported: Callable[[Column, Column], Column] = overlap_judge
    question: Callable[[Column], Column] = answers.strip_citations
    relevant: Callable[[Column, Column], Column] = overlap_judge
    recall: Callable[[Column, Column], Column] = recall_judge


def retrieved(chunks: DataFrame, points: DataFrame, questions: DataFrame, strategies: list[str], modes: list[str], encode: Encoder, expand: bool = True, top_k: int = lx.TOP_K) -> dict[tuple[str, str], DataFrame]:
    """(strategy, mode) -> results with key ``id`` of the question renamed to question_id."""
    asked = questions.select(F.col("id").alias("question_id"), F.col("question").alias("text"))
    out = {}
    for strategy in strategies:
        lists: dict[str, DataFrame | None] = {"dense_list": None, "sparse_list": None}
        own = chunks.filter(F.col("strategy") == strategy)
        if {"sparse", "hybrid"} & set(modes):
            lists["sparse_list"] = materialise(retrieval.sparse_hits(bm25.build(own, "chunk_id", "text"), asked, "question_id", expand=expand), "sparse-lists")
        if {"dense", "hybrid"} & set(modes):
            vectors = points.filter(F.col("strategy") == strategy)
            lists["dense_list"] = materialise(retrieval.dense_variants(vectors, asked, encode, "question_id", expand=expand, id_col="chunk_id", vector_col="vector"), "dense-lists")
        for mode in modes:
            out[strategy, mode] = retrieval.retrieve(mode, "question_id", top_k, **lists)
    return out


def samples(questions: DataFrame, results: DataFrame, chunks: DataFrame, strategy: str, mode: str, generate: Callable[[Column], Column] | None = None, below: float = lx.REFUSE_BELOW, domain: str | None = None) -> DataFrame:
    """One row a question of one cell; without a generator only what retrieval and the confidence gate tell."""
    texts = chunks.select(F.col("chunk_id").alias("id"), F.col("doc_id").cast("string").alias("doc_id"), "title", "section", "page_start", "page_end", "text")
    asked = questions.select(F.col("id").alias("question_id"), F.col("question").alias("text"))
    known = questions.select(F.col("id").alias("question_id"), "question", "ground_truth", "expected_docs", "answerable")
    if generate is None:
        item = F.struct("rank", "doc_id", answers.excerpt("text").alias("excerpt"))
        found = results.select("question_id", "rank", "id").join(answering.found_in(texts, results), "id").groupBy("question_id").agg(F.array_sort(F.collect_list(item)).alias("s"))
        sure = with_confidence(asked, results, "question_id", mode)
        said = sure.join(found, "question_id", "left").select("question_id", F.lit("").alias("answer"), "confidence", answers.refused("confidence", "results", below).alias("refused"), F.lit(False).alias("cited"), "s")
    else:
        full = answering.answer(asked, results, texts, "question_id", mode, generate, below=below, domain=domain)
        said = full.select("question_id", "answer", "confidence", "refused", "cited", F.transform("sources", lambda x: F.struct(x["index"].alias("rank"), x["doc_id"].alias("doc_id"), x["excerpt"].alias("excerpt"))).alias("s"))
    pick = lambda name: F.coalesce(F.transform("s", lambda x: x[name]), F.array().cast("array<string>"))
    rows = known.join(said, "question_id").select(F.lit(strategy).alias("strategy"), F.lit(mode).alias("mode"), *known.columns, "answer", "confidence", "refused", "cited", pick("excerpt").alias("contexts"), pick("doc_id").alias("retrieved_docs"))
    return rows.withColumn("hit", e.hit("expected_docs", "retrieved_docs"))


def judged(rows: DataFrame, judge: Judge, encode: Encoder) -> DataFrame:
    """Samples with the four metrics; refused and unanswerable ones have none."""
    key = [*CELL, "question_id"]
    own = rows.filter(~F.col("refused") & F.col("answerable")).withColumn("context", F.array_join("contexts", "\n\n"))
    claims = own.select(*key, "context", F.explode(judge.claims(F.col("answer"))).alias("claim"))
    faithful = claims.withColumn("v", judge.supported(F.col("claim"), F.col("context"))).groupBy(*key).agg(e.share("v").alias("faithfulness"))
    passages = own.select(*key, "question", F.explode("contexts").alias("passage")).withColumn("v", judge.relevant(F.col("question"), F.substring("passage", 1, lx.JUDGE_PASSAGE)))
    precise = passages.groupBy(*key).agg(e.share("v").alias("context_precision"))
    again = own.withColumn("again", judge.question(F.col("answer")))
    near = again.withColumn("a", encode(F.col("question"))).withColumn("b", encode(F.col("again")))
    part = judge.recall(F.col("ground_truth"), F.substring("context", 1, lx.JUDGE_CONTEXT))
    asked = (F.col("ground_truth") != "") & (F.size("contexts") > 0)
    single = near.select(*key, F.when(F.col("again") != "", e.relevancy("a", "b")).alias("answer_relevancy"), F.when(asked, part).alias("part"))
    single = single.select(*key, "answer_relevancy", e.recall_fraction("part.attributable", "part.total").alias("context_recall"))
    out = rows.join(faithful, key, "left").join(precise, key, "left").join(single, key, "left")
    return out.select(*rows.columns, *METRICS)


def run(chunks: DataFrame, points: DataFrame, questions: DataFrame, strategies: list[str], modes: list[str], encode: Encoder, generate: Callable[[Column], Column] | None = None, judge: Judge | None = None, **options) -> DataFrame:
    """The samples of the whole grid, judged if there are answers and a judge, with latency_ms (a cell's time over its questions)."""
    cells = []
    n = max(1, questions.count())
    for (strategy, mode), results in retrieved(chunks, points, questions, strategies, modes, encode, options.pop("expand", True)).items():
        rows = samples(questions, results, chunks.filter(F.col("strategy") == strategy), strategy, mode, generate, **options)
        began = time.perf_counter()
        rows = materialise(rows, "samples")
        cells.append(rows.withColumn("latency_ms", F.lit(round(1000 * (time.perf_counter() - began) / n)).cast("long")))
    every = reduce(DataFrame.unionByName, cells)
    if generate is not None and judge is not None:
        return materialise(judged(every, judge, encode), "judged")
    return every.select("*", *(F.lit(None).cast("double").alias(m) for m in METRICS))


def result_rows(rows: DataFrame, label: str) -> DataFrame:
    """Rows for the evaluation log."""
    return rows.select(F.lit(label).alias("run_label"), "strategy", F.col("mode").alias("retrieval_mode"), F.col("question_id").cast("string").alias("question_id"), "question", "answer", *METRICS, "latency_ms")


def summary(rows: DataFrame) -> DataFrame:
    """A row a cell: counts, rates and mean metrics."""
    return e.summary(rows, CELL).join(e.aggregate(rows, CELL, METRICS), CELL)
