"""Headline queries, timed: one JSON line on standard output."""

from __future__ import annotations

import importlib.util
import json
import os
import statistics
import sys
import time

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from velith.plans import catalog, flagship  # noqa: E402
from velith.session import session  # noqa: E402

HEADLINE = ["op_chunk_fixed", "op_chunk_sentence", "op_chunk_semantic", "op_split_sentences", "op_clean_text", "op_bm25_idf", "op_bm25_topk", "op_bm25_multiquery", "op_dense_topk_cosine", "op_merge_labels", "op_knowledge_base", "op_eval_grid", "op_upsert_documents", "op_detect_language", "op_context_budget"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    every = {"flagship": flagship.hybrid_answers, **catalog.queries()}
    names = ["flagship", *HEADLINE]
    if importlib.util.find_spec("velith.llm") is not None and importlib.util.find_spec("velith.llm.queries") is not None and os.environ.get("BENCH_LLM", "1") == "1":
        from velith.llm import queries as llm

        every |= llm.queries()
        names += sorted(llm.queries())
    spark.read.parquet(f"{folder}/documents.parquet").selectExpr("sum(length(text))").collect()  # the session is up
    seconds = {}
    for name in names:
        runs = []
        for _ in range(int(os.environ.get("BENCH_RUNS", "1"))):
            began = time.perf_counter()
            every[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(runs), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
