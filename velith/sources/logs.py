"""Logs of a knowledge base: ingestion runs, questions asked, evaluation results, experiments.

Each is a table of snapshots that rows are appended to; an append writes only its own rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velith.sources.snapshots import SnapshotTable

RUNS = "run_id string, corpus string, strategy string, event string, at timestamp, documents_seen long, documents_new long, documents_changed long, documents_skipped long, chunks_written long, error string"
QUERIES = "session_id string, question string, answer string, strategy string, retrieval_mode string, confidence double, refused boolean, chunk_ids array<string>, latency_ms long, llm_model string, created_at timestamp"
EVALUATIONS = "run_label string, strategy string, retrieval_mode string, question_id string, question string, answer string, faithfulness double, answer_relevancy double, context_precision double, context_recall double, latency_ms long, created_at timestamp"
EXPERIMENTS = "run_label string, params map<string,string>, metrics map<string,double>, samples string, created_at timestamp"


class Logs:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.run_events, self.queries, self.evaluations, self.experiments = (SnapshotTable(spark, f"{path}/logs/{name}", kind) for name, kind in (("runs", RUNS), ("queries", QUERIES), ("evaluations", EVALUATIONS), ("experiments", EXPERIMENTS)))

    def _event(self, run: str, corpus: str | None, strategy: str | None, event: str, counters: Mapping[str, int], error: str | None) -> None:
        names = ("seen", "new", "changed", "skipped", "chunks")
        counts = [None if event == "started" else int(counters.get(n, 0)) for n in names]
        kinds = ", ".join(f for f in RUNS.split(", ") if not f.startswith("at "))
        row = self.spark.createDataFrame([(run, corpus, strategy, event, *counts, error)], kinds)
        self.run_events.append(row.withColumn("at", F.current_timestamp()))

    def start_run(self, corpus: str, strategy: str) -> str:
        """The id of a run that has begun."""
        run = uuid.uuid4().hex
        self._event(run, corpus, strategy, "started", {}, None)
        return run

    def finish_run(self, run: str, counters: Mapping[str, int], error: str | None = None) -> None:
        self._event(run, None, None, "failed" if error else "success", counters, error)

    def runs(self) -> DataFrame:
        """One row a run: what it took, when it began and ended, its counters, and whether it runs, succeeded or failed."""
        end = F.col("event") != "started"
        last = lambda c: F.max(F.when(end, F.col(c))).alias(c)
        counts = ("documents_seen", "documents_new", "documents_changed", "documents_skipped", "chunks_written")
        return self.run_events.read().groupBy("run_id").agg(F.max("corpus").alias("corpus"), F.max("strategy").alias("strategy"), F.min("at").alias("started_at"), F.max(F.when(end, F.col("at"))).alias("finished_at"), *map(last, counts), F.coalesce(F.max(F.when(end, F.col("event"))), F.lit("running")).alias("status"), last("error"))

    def _rows(self, table: SnapshotTable, rows: DataFrame) -> None:
        kinds = {f.name: f.dataType for f in self.spark.createDataFrame([], table.schema).schema}
        own = rows if "created_at" in rows.columns else rows.withColumn("created_at", F.current_timestamp())
        table.append(own.select(*((F.col(c) if c in own.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items())))

    def log_queries(self, rows: DataFrame, warn: Callable[[str], None] = print) -> bool:
        """Append asked questions; a log that can't be written doesn't fail the answer."""
        try:
            self._rows(self.queries, rows)
        except Exception as problem:
            warn(f"questions were not logged: {problem}")
            return False
        return True

    def log_evaluations(self, rows: DataFrame) -> None:
        self._rows(self.evaluations, rows)

    def log_experiment(self, label: str, params: Mapping[str, object], metrics: Mapping[str, float | None], samples: DataFrame, cut: int = 200) -> None:
        """One experiment: settings, the metrics that are numbers, and the samples as JSON with their contexts cut."""
        short = samples.withColumn("contexts", F.transform("contexts", lambda c: F.substring(c, 1, cut))) if "contexts" in samples.columns else samples
        packed = short.agg(F.to_json(F.collect_list(F.struct(*short.columns))).alias("samples"))  # an evaluation's questions, written by hand
        numbers = {k: float(v) for k, v in metrics.items() if isinstance(v, (int, float)) and not isinstance(v, bool)}
        head = self.spark.createDataFrame([(label, {k: json.dumps(v) if isinstance(v, (list, dict)) else str(v) for k, v in params.items()}, numbers)], "run_label string, params map<string,string>, metrics map<string,double>")
        self._rows(self.experiments, head.crossJoin(packed))
