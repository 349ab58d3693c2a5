"""Command line: ``python -m velith.cli COMMAND``; a thin layer over the library."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import functions as F

from velith.functions.answers import MODES
from velith.operators import evaluation, statistics
from velith.plans import answering, evaluating, retrieval
from velith.plans.ingestion import KnowledgeBase, embed, ingest
from velith.session import session
from velith.sources import corpora, files, models
from velith.sources.scratch import materialise


def _chunks(base: KnowledgeBase, strategy: str):
    """Chunks of a strategy in the form that answers are made from."""
    titles = base.documents.read().select("doc_id", "title")
    own = base.chunks.read().filter(F.col("strategy") == strategy)
    return own.join(titles, "doc_id", "left").withColumn("id", F.col("chunk_id"))


def _found(base: KnowledgeBase, args: argparse.Namespace):
    spark = base.spark
    chunks = _chunks(base, args.strategy)
    asked = spark.createDataFrame([(k, q) for k, q in enumerate(args.question)], "question_id long, text string")
    encode = models.encoder()
    results = retrieval.search_chunks(base.chunks.read().join(base.documents.read().select("doc_id", "category"), "doc_id", "left"), base.points.read(), asked, "question_id", encode, args.mode, args.strategy, args.top_k, args.doc, args.category, not args.no_expand)
    return asked, results, chunks


def _evaluate(base: KnowledgeBase, args: argparse.Namespace) -> str:
    """Run the grid, log its rows and the experiment, and return the table of its summary."""
    questions = files.question_set(base.spark, args.questions)
    titles = base.documents.read().select("doc_id", "title")
    chunks = base.chunks.read().join(titles, "doc_id", "left")
    generate, judge = (None, None) if args.retrieval_only else (models.generator(), evaluating.Judge())
    rows = evaluating.run(chunks, base.points.read(), questions, args.strategy, args.mode, models.encoder(), generate, judge)
    summary = evaluating.summary(rows)
    base.logs.log_evaluations(evaluating.result_rows(rows, args.label))
    cells = {f"{r['strategy']}.{r['mode']}.{k}": v for r in summary.collect() for k, v in r.asDict().items() if k not in evaluating.CELL}
    base.logs.log_experiment(args.label, {"strategies": args.strategy, "modes": args.mode, "retrieval_only": args.retrieval_only}, cells, rows)
    return evaluation.format_table(summary, args.retrieval_only)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="velith")
    parser.add_argument("--base", default="knowledge-base", help="folder of the knowledge base")
    commands = parser.add_subparsers(dest="command", required=True)
    take = commands.add_parser("ingest", help="take in new and changed files")
    take.add_argument("folder")
    take.add_argument("--pattern", default="*.txt")
    take.add_argument("--corpus", default="german_labour_law", choices=sorted(corpora.CORPORA))
    take.add_argument("--strategy", nargs="+", default=["fixed", "sentence", "semantic"])
    take.add_argument("--limit", type=int)
    vectors = commands.add_parser("embed", help="make the vectors that are missing, remove those of no chunk")
    vectors.add_argument("--strategy")
    vectors.add_argument("--recreate", action="store_true")
    for name, text in (("search", "find chunks"), ("ask", "answer from chunks")):
        one = commands.add_parser(name, help=text)
        one.add_argument("question", nargs="+")
        one.add_argument("--strategy", default="sentence")
        one.add_argument("--top-k", type=int, default=5)
        one.add_argument("--no-expand", action="store_true")
        one.add_argument("--mode", default="hybrid", choices=MODES)
        one.add_argument("--doc", nargs="+", help="look in these documents only")
        one.add_argument("--category", help="look in documents of this category only")
        one.add_argument("--domain", default="the documents at hand")
    grid = commands.add_parser("evaluate", help="ask a question set and sum up what came back")
    grid.add_argument("questions", help="JSON file with a list of questions")
    grid.add_argument("--strategy", nargs="+", default=["sentence"])
    grid.add_argument("--mode", nargs="+", default=["hybrid"], choices=MODES)
    grid.add_argument("--label", default="run")
    grid.add_argument("--retrieval-only", action="store_true")
    commands.add_parser("stats", help="chunks and documents by strategy")
    gone = commands.add_parser("delete", help="documents with all that hangs on them")
    gone.add_argument("doc_id", nargs="+")
    args = parser.parse_args(argv)

    spark = session("velith", os.environ.get("VELITH_MASTER"))
    spark.sparkContext.setLogLevel("ERROR")
    base = KnowledgeBase(spark, args.base)
    say = lambda rows: print("\n".join(json.dumps(r.asDict(recursive=True), ensure_ascii=False, default=str) for r in rows))
    if args.command == "ingest":
        print(json.dumps(ingest(base, files.scan(spark, args.folder, args.pattern, args.limit), corpora.corpus(spark, args.corpus), args.strategy, corpus=args.corpus)))
    elif args.command == "evaluate":
        print(_evaluate(base, args))
    elif args.command == "embed":
        print(json.dumps(embed(base, models.encoder(), args.strategy, args.recreate)))
    elif args.command == "search":
        _, results, chunks = _found(base, args)
        say(answering.sources(results, chunks, "question_id").orderBy("question_id", "rank").collect())
    elif args.command == "ask":
        asked, results, chunks = _found(base, args)
        answers = materialise(answering.answer(asked, results, chunks, "question_id", args.mode, models.generator(), domain=args.domain), "answers")
        base.logs.log_queries(answering.log_rows(answers, "question_id", args.strategy, args.mode, "stand-in"))
        say(answers.orderBy("question_id").collect())
    elif args.command == "stats":
        say(statistics.chunk_stats(base.chunks.read()).orderBy("strategy").collect())
    else:
        base.delete(spark.createDataFrame([(x,) for x in args.doc_id], "doc_id string"))
    return 0


if __name__ == "__main__":
    sys.exit(main())
