"""Metrics, grids and incremental ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velith.operators import evaluation as e
from velith.operators.chunking import as_pages, sentence_chunks
from velith.functions import lexicon as lx
from velith.plans.catalog import inputs as i
from velith.plans.catalog.text import sentence_sql
from velith.sources.scratch import scratch_path
from velith.sources.snapshots import SnapshotTable
from velith.streaming.ingest import append_batches, parquet_stream, run_available


def op_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return i.samples(spark, sf_dir).select("question_id", e.hit("expected_docs", "retrieved_docs").alias("hit"))


def op_refusal_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return i.samples(spark, sf_dir).groupBy("strategy", "mode").agg(F.round(F.avg(e.refusal_correct("answerable", "refused").cast("int")), 4).alias("refusal_accuracy"))


def op_citation_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return i.samples(spark, sf_dir).groupBy("strategy", "mode").agg(F.round(F.avg(F.when(F.col("answerable"), F.col("cited").cast("int"))), 4).alias("citation_rate"))


def _verdict(true: str, false: str):
    return F.when(F.col("l_returnflag") == true, True).when(F.col("l_returnflag") == false, False)


def op_faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return i.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("question_id")).agg(e.share(_verdict("A", "R")).alias("faithfulness"))


def op_context_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return i.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("question_id")).agg(e.share(_verdict("N", "A")).alias("context_precision"))


def op_context_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = i.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("question_id")).agg(F.count_if(F.col("l_linestatus") == "F").alias("f"), F.count_if(F.col("l_returnflag") != "N").alias("t"))
    return rows.select("question_id", e.recall_fraction("f", "t").alias("context_recall"))


def op_answer_relevancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = i.table(spark, sf_dir, "embeddings")
    other = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(other, "vec_id").select("vec_id", e.relevancy("embedding", "other").alias("answer_relevancy"))


def op_eval_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = i.samples(spark, sf_dir).withColumn("hit", e.hit("expected_docs", "retrieved_docs"))
    return e.summary(samples, ["strategy", "mode"])


def op_format_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = op_eval_grid(spark, sf_dir)
    return grid.select("strategy", "mode", e.table_row(grid, retrieval_only=True).alias("row"))


def op_ab_encoders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two encoders side by side: the nearest of the three last passages of each label for its first two vectors."""
    from pyspark.sql import Window

    v = i.table(spark, sf_dir, "embeddings").filter("label is not null")
    up, down = Window.partitionBy("label").orderBy("vec_id"), Window.partitionBy("label").orderBy(F.col("vec_id").desc())
    asked = v.withColumn("k", F.row_number().over(up)).filter("k <= 2").select("label", F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    there = v.withColumn("k", F.row_number().over(down)).filter("k <= 3").select("label", "vec_id", "embedding")
    from velith.functions.vectors import cosine

    both = [("whole", lambda x: F.col(x)), ("half", lambda x: F.slice(x, 1, 32))]
    pairs = asked.join(there, "label")
    scored = [pairs.select(F.lit(name).alias("encoder"), "query_id", "vec_id", F.round(cosine(cut("q"), cut("embedding")), 6).alias("score")) for name, cut in both]
    best = Window.partitionBy("encoder", "query_id").orderBy(F.col("score").desc(), "vec_id")
    return scored[0].union(scored[1]).withColumn("k", F.row_number().over(best)).filter("k = 1").drop("k")


def op_stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents taken in as a stream, chunked and stored; the result is the stored table."""
    folder = scratch_path(spark, "stream")
    schema = "doc_id long, strategy string, chunk_index int, chunk_id string, text string, token_count int, page_start int, page_end int, section string"
    table = SnapshotTable(spark, f"{folder}/chunks", schema, key="doc_id")
    stream = parquet_stream(spark, f"{sf_dir}/documents.parquet*", "doc_id long, text string, lang string, source string, n_chars long")
    run_available(stream, append_batches(table, ["doc_id"], lambda batch: sentence_chunks(as_pages(batch))), f"{folder}/checkpoint")
    return table.read()


GRID = f"""SELECT strategy, mode, count(*) AS questions, round(avg(CASE WHEN len(expected_docs) > 0 THEN CAST(list_has_any(expected_docs, retrieved_docs) AS INTEGER) END), 4) AS retrieval_hit_rate,
    round(avg(CAST(answerable <> refused AS INTEGER)), 4) AS refusal_accuracy, round(avg(CASE WHEN answerable THEN CAST(cited AS INTEGER) END), 4) AS citation_rate, round(avg(confidence), 4) AS avg_confidence, CAST(round(avg(latency_ms), 0) AS BIGINT) AS avg_latency_ms FROM ({i.SAMPLES}) GROUP BY ALL"""

SQL = {
    "op_stream_ingest": sentence_sql(lx.SENTENCE_TOKENS),
    "op_hit_rate": f"SELECT question_id, CASE WHEN len(expected_docs) > 0 THEN list_has_any(expected_docs, retrieved_docs) END AS hit FROM ({i.SAMPLES})",
    "op_refusal_accuracy": f"SELECT strategy, mode, refusal_accuracy FROM ({GRID})",
    "op_citation_rate": f"SELECT strategy, mode, citation_rate FROM ({GRID})",
    "op_faithfulness": "SELECT l_orderkey AS question_id, round(avg(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 0 END), 4) AS faithfulness FROM lineitem GROUP BY l_orderkey",
    "op_context_precision": "SELECT l_orderkey AS question_id, round(avg(CASE l_returnflag WHEN 'N' THEN 1 WHEN 'A' THEN 0 END), 4) AS context_precision FROM lineitem GROUP BY l_orderkey",
    "op_context_recall": "SELECT l_orderkey AS question_id, CASE WHEN t > 0 THEN round(least(1, f / t), 4) END AS context_recall FROM (SELECT l_orderkey, count(*) FILTER (WHERE l_linestatus = 'F') AS f, count(*) FILTER (WHERE l_returnflag <> 'N') AS t FROM lineitem GROUP BY l_orderkey)",
    "op_answer_relevancy": "SELECT a.vec_id, round(greatest(0, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))), 4) AS answer_relevancy FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) a JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) b ON b.vec_id = a.vec_id + 1",
    "op_eval_grid": GRID,
    "op_format_table": f"SELECT strategy, mode, '| ' || strategy || ' | ' || mode || ' | ' || CAST(CAST(round(CAST(retrieval_hit_rate AS DECIMAL(18, 4)), 3) AS DECIMAL(18, 3)) AS VARCHAR) || ' | ' || CAST(CAST(round(CAST(refusal_accuracy AS DECIMAL(18, 4)), 3) AS DECIMAL(18, 3)) AS VARCHAR) || ' | ' || CAST(CAST(round(CAST(avg_confidence AS DECIMAL(18, 4)), 3) AS DECIMAL(18, 3)) AS VARCHAR) || ' | ' || format('{{:,}}', avg_latency_ms) || ' ms |' AS row FROM ({GRID})",
    "op_ab_encoders": """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL), a AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 2), p AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) <= 3),
        s AS (SELECT e AS encoder, a.vec_id AS query_id, p.vec_id, round(list_dot_product(a.v[1:n], p.v[1:n]) / (sqrt(list_dot_product(a.v[1:n], a.v[1:n])) * sqrt(list_dot_product(p.v[1:n], p.v[1:n]))), 6) AS score FROM a JOIN p USING (label), (VALUES ('whole', 64), ('half', 32)) x(e, n))
        SELECT encoder, query_id, vec_id, score FROM s QUALIFY row_number() OVER (PARTITION BY encoder, query_id ORDER BY score DESC, vec_id) = 1""",
}
