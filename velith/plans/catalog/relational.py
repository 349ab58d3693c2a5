"""The knowledge base as tables: statistics, scans, changes by key, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velith.operators import statistics, store
from velith.operators.sizes import bounded
from velith.plans.catalog import inputs as i
from velith.sources.corpora import CORPORA, corpus, described


def op_chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.chunk_stats(i.chunks(spark, sf_dir))


def op_knowledge_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.knowledge_base(i.doc_rows(spark, sf_dir), i.chunks(spark, sf_dir))


def op_kb_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.knowledge_totals(op_knowledge_base(spark, sf_dir))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = lambda c, n: F.when(F.col("l_partkey") % n != 0, F.col(c))
    return i.table(spark, sf_dir, "lineitem").select(
        F.date_format("l_shipdate", "yyyy").alias("run_label"),
        F.when(F.col("l_returnflag") == "A", "fixed").otherwise("sentence").alias("strategy"),
        F.when(F.col("l_linestatus") == "F", "hybrid").otherwise("dense").alias("retrieval_mode"),
        even("l_discount", 3).alias("faithfulness"),
        even("l_tax", 4).alias("answer_relevancy"),
        even("l_discount", 5).alias("context_precision"),
        F.when(F.col("l_linestatus") == "F", F.col("l_tax")).alias("context_recall"),
        F.col("l_quantity").cast("int").alias("latency_ms"),
    )


def op_eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.evaluation_summary(_results(spark, sf_dir))


def op_query_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = i.table(spark, sf_dir, "events").select((F.col("event_type") == "error").alias("refused"), (F.col("value") / 100).alias("confidence"), F.col("value").alias("latency_ms"))
    return statistics.query_stats(log)


def op_has_all_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.has_all_chunks(i.doc_rows(spark, sf_dir), i.chunks(spark, sf_dir), ["fixed", "semantic"])


def op_chunk_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = store.pending(i.chunks(spark, sf_dir), "sentence")
    return own.join(i.doc_rows(spark, sf_dir).select("doc_id", "title", "category"), "doc_id").select("chunk_id", "doc_id", "chunk_index", "token_count", "title", "category")


def op_unembedded_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.pending(i.chunks(spark, sf_dir)).select("chunk_id", "strategy")


def op_multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the orders of the building segment, with their documents."""
    wanted = i.table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    ids = i.table(spark, sf_dir, "orders").join(bounded(wanted), "o_custkey", "left_semi").select(F.col("o_orderkey").alias("doc_id"))
    return i.chunks(spark, sf_dir).join(ids, "doc_id", "left_semi").join(i.doc_rows(spark, sf_dir).select("doc_id", "title"), "doc_id").select("chunk_id", "doc_id", "title", "strategy")


def op_vector_scroll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return i.table(spark, sf_dir, "embeddings").filter("label = 3").select("vec_id")


def op_record_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored values win over those sent along, empty ones don't."""
    rows = i.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_name")).alias("stored"), "p_brand")
    found = i.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("sent"))
    return found.join(rows, "key", "left").select("l_orderkey", "l_linenumber", "key", F.coalesce(F.nullif("stored", F.lit("")), "sent").alias("title"), "p_brand")


def _changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    old = i.doc_rows(spark, sf_dir).filter("category != 'O'").select("doc_id", "title", "category", F.lit(1).alias("ingested_at"))
    new = i.doc_rows(spark, sf_dir).filter("category != 'F'").select("doc_id", F.concat("title", F.lit(" new")).alias("title"), F.lit("N").alias("category"), F.lit(2).alias("ingested_at"))
    return old, new


def op_upsert_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.upsert(*_changes(spark, sf_dir), ["doc_id"], keep=("ingested_at",))


def op_replace_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = i.chunks(spark, sf_dir)
    new = old.filter("chunk_index = 1 AND strategy != 'fixed'").select("doc_id", "strategy", F.concat("chunk_id", F.lit("-new")).alias("chunk_id"), "chunk_index", (F.col("token_count") + 1).alias("token_count"), F.lit(False).alias("embedded"))
    return store.replace_groups(old, new, ["doc_id", "strategy"])


def op_delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = i.doc_rows(spark, sf_dir).filter("category = 'P'").select("doc_id")
    docs, chunks = store.delete_cascade(gone, "doc_id", i.doc_rows(spark, sf_dir), i.chunks(spark, sf_dir))
    return docs.select(F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("id")).union(chunks.select(F.lit("chunk"), "chunk_id"))


def op_mark_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = i.chunks(spark, sf_dir)
    return store.mark(chunks, chunks.filter("token_count > 25").select("chunk_id"), "chunk_id", "embedded", F.lit(True)).select("chunk_id", "strategy", "token_count", "embedded")


def op_reset_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = i.chunks(spark, sf_dir)
    return chunks.select("chunk_id", "strategy", F.when(F.col("strategy") == "fixed", False).otherwise(F.col("embedded")).alias("embedded"))


def op_prune_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = i.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    kept, gone = store.prune(points, i.table(spark, sf_dir, "documents").filter("lang != 'fr'"), "doc_id")
    return kept.select("doc_id", F.lit(True).alias("kept")).union(gone.select("doc_id", F.lit(False)))


def op_vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = i.table(spark, sf_dir, "events").select(F.col("user_id").alias("point_id"), "event_id", "event_type", "value")
    return store.last_wins(points, ["point_id"], "event_id")


def op_ingest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = i.doc_rows(spark, sf_dir)
    known = i.doc_rows(spark, sf_dir).filter("category != 'P'").select("doc_id", F.when(F.col("language") == "5-LOW", "other").otherwise(F.col("content_hash")).alias("content_hash"))
    return statistics.ingest_status(files, known, statistics.has_all_chunks(files, i.chunks(spark, sf_dir), ["fixed"]))


def op_ingest_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.ingest_counters(op_ingest_status(spark, sf_dir))


def op_health_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when((F.col("event_type") == "error") & (F.col("value") > 190), "down").when(F.col("event_type") == "error", "degraded").otherwise("ok")
    return statistics.health(i.table(spark, sf_dir, "events").select("user_id", state.alias("status")), ["user_id"])


def op_corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files named after parts, described by the registry: by file name, by lower-cased stem, or by themselves."""
    names = [e[3] for e in CORPORA["german_labour_law"]]
    pick = F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % len(names) + 1).cast("int"))
    name = F.when(F.col("p_size") % 3 == 0, pick).when(F.col("p_size") % 3 == 1, F.upper(pick)).otherwise(F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".txt")))
    files = i.table(spark, sf_dir, "part").select("p_partkey", name.alias("filename"))
    return described(files, corpus(spark, "german_labour_law"))


RESULTS = """SELECT strftime(l_shipdate, '%Y') AS run_label, CASE l_returnflag WHEN 'A' THEN 'fixed' ELSE 'sentence' END AS strategy, CASE l_linestatus WHEN 'F' THEN 'hybrid' ELSE 'dense' END AS retrieval_mode,
    CASE WHEN l_partkey % 3 <> 0 THEN l_discount END AS faithfulness, CASE WHEN l_partkey % 4 <> 0 THEN l_tax END AS answer_relevancy, CASE WHEN l_partkey % 5 <> 0 THEN l_discount END AS context_precision, CASE WHEN l_linestatus = 'F' THEN l_tax END AS context_recall, CAST(l_quantity AS INTEGER) AS latency_ms FROM lineitem"""
STATUS = f"""SELECT f.doc_id, CASE WHEN k.doc_id IS NULL THEN 'new' WHEN k.h = f.content_hash AND c.doc_id IS NOT NULL THEN 'skipped' ELSE 'changed' END AS status
    FROM ({i.DOC_ROWS}) f LEFT JOIN (SELECT doc_id, CASE language WHEN '5-LOW' THEN 'other' ELSE content_hash END AS h FROM ({i.DOC_ROWS}) WHERE category <> 'P') k USING (doc_id) LEFT JOIN (SELECT DISTINCT doc_id FROM ({i.CHUNKS}) WHERE strategy = 'fixed') c ON c.doc_id = f.doc_id"""
BASE = f"SELECT d.*, count(chunk_id) FILTER (WHERE embedded) AS embedded_chunks, count(chunk_id) AS total_chunks FROM ({i.DOC_ROWS}) d LEFT JOIN ({i.CHUNKS}) c USING (doc_id) GROUP BY ALL"
ENTRIES = "(VALUES " + ", ".join("(" + ", ".join(map(i.q, e)) + ")" for e in CORPORA["german_labour_law"]) + ") x(doc_id, title, url, filename, language, category)"

SQL = {
    "op_chunk_stats": f"SELECT strategy, count(*) AS chunks, count(*) FILTER (WHERE embedded) AS embedded, count(DISTINCT doc_id) AS documents, round(avg(token_count), 0) AS avg_tokens, min(token_count) AS min_tokens, max(token_count) AS max_tokens FROM ({i.CHUNKS}) GROUP BY strategy",
    "op_knowledge_base": BASE,
    "op_kb_totals": f"SELECT count(*) AS documents, CAST(sum(total_chunks) AS BIGINT) AS chunks, CAST(sum(embedded_chunks) AS BIGINT) AS embedded FROM ({BASE})",
    "op_eval_summary": f"SELECT run_label, strategy, retrieval_mode, count(*) AS questions, round(avg(faithfulness), 4) AS faithfulness, round(avg(answer_relevancy), 4) AS answer_relevancy, round(avg(context_precision), 4) AS context_precision, round(avg(context_recall), 4) AS context_recall, round(avg(latency_ms), 0) AS avg_latency_ms FROM ({RESULTS}) GROUP BY ALL",
    "op_query_stats": "SELECT count(*) AS total, count(*) FILTER (WHERE event_type = 'error') AS refused, round(avg(value / 100), 3) AS avg_confidence, round(avg(value), 0) AS avg_latency_ms FROM events",
    "op_has_all_chunks": f"SELECT doc_id, coalesce(n, 0) = 2 AS complete FROM ({i.DOC_ROWS}) LEFT JOIN (SELECT doc_id, count(DISTINCT strategy) AS n FROM ({i.CHUNKS}) WHERE strategy <> 'sentence' GROUP BY doc_id) USING (doc_id)",
    "op_chunk_scan": f"SELECT chunk_id, doc_id, chunk_index, token_count, title, category FROM ({i.CHUNKS}) JOIN ({i.DOC_ROWS}) USING (doc_id) WHERE strategy = 'sentence' AND NOT embedded",
    "op_unembedded_scan": f"SELECT chunk_id, strategy FROM ({i.CHUNKS}) WHERE NOT embedded",
    "op_multi_get": f"SELECT chunk_id, doc_id, title, strategy FROM ({i.CHUNKS}) JOIN ({i.DOC_ROWS}) USING (doc_id) WHERE doc_id IN (SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING')",
    "op_vector_scroll": "SELECT vec_id FROM embeddings WHERE label = 3",
    "op_record_override": "SELECT l_orderkey, l_linenumber, l_partkey AS key, coalesce(CASE WHEN p_size % 2 <> 0 THEN nullif(p_name, '') END, l_returnflag) AS title, p_brand FROM lineitem LEFT JOIN part ON p_partkey = l_partkey",
    "op_upsert_documents": f"""WITH o AS (SELECT doc_id, title, category, 1 AS ingested_at FROM ({i.DOC_ROWS}) WHERE category <> 'O'), n AS (SELECT doc_id, title || ' new' AS title, 'N' AS category, 2 AS ingested_at FROM ({i.DOC_ROWS}) WHERE category <> 'F')
        SELECT doc_id, coalesce(n.title, o.title) AS title, coalesce(n.category, o.category) AS category, coalesce(o.ingested_at, n.ingested_at) AS ingested_at FROM o FULL JOIN n USING (doc_id)""",
    "op_replace_chunks": f"""WITH o AS ({i.CHUNKS}), n AS (SELECT doc_id, strategy, chunk_id || '-new' AS chunk_id, chunk_index, token_count + 1 AS token_count, false AS embedded FROM o WHERE chunk_index = 1 AND strategy <> 'fixed')
        SELECT * FROM o WHERE (doc_id, strategy) NOT IN (SELECT doc_id, strategy FROM n) UNION ALL SELECT * FROM n""",
    "op_delete_cascade": f"SELECT 'document' AS kind, CAST(doc_id AS VARCHAR) AS id FROM ({i.DOC_ROWS}) WHERE category <> 'P' UNION ALL SELECT 'chunk', chunk_id FROM ({i.CHUNKS}) WHERE doc_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')",
    "op_mark_embedded": f"SELECT chunk_id, strategy, token_count, embedded OR chunk_id IN (SELECT chunk_id FROM ({i.CHUNKS}) WHERE token_count > 25) AS embedded FROM ({i.CHUNKS})",
    "op_reset_embedded": f"SELECT chunk_id, strategy, embedded AND strategy <> 'fixed' AS embedded FROM ({i.CHUNKS})",
    "op_prune_orphans": "SELECT vec_id AS doc_id, vec_id IN (SELECT doc_id FROM documents WHERE lang <> 'fr') AS kept FROM embeddings",
    "op_vector_upsert": "SELECT user_id AS point_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id",
    "op_ingest_status": STATUS,
    "op_ingest_counters": f"SELECT count(*) AS seen, count(*) FILTER (WHERE status = 'new') AS new, count(*) FILTER (WHERE status = 'changed') AS changed, count(*) FILTER (WHERE status = 'skipped') AS skipped FROM ({STATUS})",
    "op_health_rollup": "SELECT user_id, CASE WHEN bool_or(event_type = 'error' AND value > 190) THEN 'down' WHEN bool_or(event_type = 'error') THEN 'degraded' ELSE 'ok' END AS status FROM events GROUP BY user_id",
    "op_corpus_files": f"""WITH e AS (SELECT *, row_number() OVER () - 1 AS k FROM {ENTRIES}),
        f AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN e.filename WHEN 1 THEN upper(e.filename) ELSE replace(p_name, ' ', '_') || '.txt' END AS filename FROM part JOIN e ON k = p_partkey % 26),
        s AS (SELECT *, regexp_replace(filename, '\\.[^.]*$', '') AS stem FROM f)
        SELECT coalesce(a.doc_id, b.doc_id, lower(stem)) AS doc_id, coalesce(a.title, b.title, stem) AS title, coalesce(a.url, b.url, '') AS url, coalesce(a.language, b.language, 'de') AS language, coalesce(a.category, b.category, 'uploaded') AS category, p_partkey, s.filename
        FROM s LEFT JOIN e a ON a.filename = s.filename LEFT JOIN e b ON b.doc_id = lower(stem)""",
}
