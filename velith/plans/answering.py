"""Answers to a table of questions: gate, prompt, generation, citations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velith.functions import lexicon as lx
from velith.functions.answers import citation, excerpt, extract_citations, is_refusal, refused
from velith.operators.context import REFUSAL, system_prompt, user_prompt
from velith.operators.fusion import with_confidence
from velith.functions.answers import detect_language
from velith.operators.sizes import bounded
from velith.sources.scratch import materialise


def found_in(chunks: DataFrame, results: DataFrame) -> DataFrame:
    """The chunks that are among the results: their texts are neither shuffled nor sorted beside all the others.

    The ids are looked at more than once; results of a search should be a written table.
    """
    return chunks.join(bounded(results.select("id").distinct()), "id", "left_semi")


def sources(results: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Results with their chunk's text, citation and excerpt; chunks have id, title, doc_id, section, page_start, page_end, text."""
    own = found_in(chunks.select("id", "title", "doc_id", "section", "page_start", "page_end", "text"), results)
    joined = results.join(own, "id", "left")
    return joined.select(key, "rank", "id", "doc_id", "section", "text", citation("title", "doc_id", "section", "page_start", "page_end").alias("citation"), excerpt("text").alias("excerpt"), F.round("score", 6).alias("score"), "retriever")


def answer(questions: DataFrame, results: DataFrame, chunks: DataFrame, key: str, mode: str, generate: Callable[[Column], Column], text_col: str = "text", budget: int = lx.CONTEXT, below: float = lx.REFUSE_BELOW, domain: str | None = None, language: str = "auto", history: DataFrame | None = None) -> DataFrame:
    """(key, question, answer, confidence, refused, cited, sources) of every question.

    Questions below the threshold never reach the model: its function sees a null prompt for them.  With a domain the prompt
    opens with the instructions for it; ``history`` has the earlier turns (key, turn_rank, question, answer) that are to be
    told, as ``operators.context.remembered`` picks them.
    """
    item = F.struct("rank", "id", "doc_id", "section", "text", "citation", "excerpt", "score", "retriever")
    results = materialise(results, "results")
    found = sources(results, chunks, key).groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("s"))
    asked = questions.select(key, F.col(text_col).alias("question")).join(with_confidence(questions, results, key, mode), key).join(found, key, "left")
    if history is not None:
        turn = F.struct(-F.col("turn_rank").alias("at"), "question", "answer")
        told = history.groupBy(key).agg(F.array_sort(F.collect_list(turn)).alias("history"))
        asked = asked.join(told, key, "left")
    gate = asked.withColumn("gated", refused("confidence", "results", below))
    prompt = user_prompt("question", F.transform("s", lambda x: x["citation"]), F.transform("s", lambda x: x["text"]), "history" if history is not None else None, budget=budget)
    if domain is not None:
        prompt = F.concat(system_prompt("question", domain, language), F.lit("\n\n"), prompt)
    said = gate.withColumn("prompt", F.when(~F.col("gated"), prompt)).withColumn("said", generate(F.col("prompt")))
    none = F.when(detect_language("question") == "German", REFUSAL["German"]).otherwise(REFUSAL["English"])
    text = F.when(F.col("gated"), none).otherwise(F.col("said"))
    out = said.select(key, "question", text.alias("answer"), "confidence", "gated", F.coalesce("s", F.array().cast(gate.schema["s"].dataType)).alias("s"))
    cites = extract_citations("answer", F.size("s"))
    out = out.withColumn("cites", cites).withColumn("refused", F.col("gated") | is_refusal("answer"))
    marked = F.transform("s", lambda x: F.struct(x["rank"].alias("index"), x["id"].alias("id"), x["doc_id"].alias("doc_id"), x["citation"].alias("citation"), x["excerpt"].alias("excerpt"), x["score"].alias("score"), x["retriever"].alias("retriever"), F.array_contains("cites", x["rank"]).alias("cited")))
    return out.select(key, "question", "answer", "confidence", "refused", (F.size("cites") > 0).alias("cited"), marked.alias("sources"))


def events(answers: DataFrame, key: str):
    """What a client is told while it waits, question by question: sources, then the answer word by word, then the outcome.

    Rows come to the driver one at a time.
    """
    for row in answers.toLocalIterator():
        yield {"event": "sources", key: row[key], "sources": [s.asDict() for s in row["sources"]]}
        for word in (row["answer"] or "").split():
            yield {"event": "token", key: row[key], "text": word}
        yield {"event": "done", key: row[key], "confidence": row["confidence"], "refused": row["refused"]}


def log_rows(answers: DataFrame, key: str, strategy: str, mode: str, model: str) -> DataFrame:
    """Rows for the query log."""
    return answers.select(F.col(key).alias("session_id"), "question", "answer", F.lit(strategy).alias("strategy"), F.lit(mode).alias("retrieval_mode"), "confidence", "refused", F.transform("sources", lambda s: s["id"].cast("string")).alias("chunk_ids"), F.lit(model).alias("llm_model"), F.current_timestamp().alias("created_at"))
