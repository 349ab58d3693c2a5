"""Sparse and dense search, fusion, confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velith.functions import lexicon as lx
from velith.functions.answers import refused
from velith.operators import bm25, dense, fusion
from velith.operators.chunking import letter_encoder
from velith.plans import evaluating, retrieval
from velith.plans.catalog import inputs as i


_built: dict[tuple, bm25.Index] = {}


def _there(spark: SparkSession, files: list[str]) -> bool:
    paths = [spark._jvm.org.apache.hadoop.fs.Path(x) for x in files]
    return all(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) for p in paths)


def _index(spark: SparkSession, sf_dir: str) -> bm25.Index:
    """The index over documents: written by the first query of a session that asks for it, read by the others.

    It counts for the very files it was built from: their names, sizes and times are part of its key.  Where its own files
    have been cleared away it is built again.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.listStatus(where)
    key = (spark.sparkContext.applicationId, *sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in found))
    if key not in _built or not _there(spark, _built[key].postings.inputFiles()[:1]):
        _built[key] = bm25.build(i.table(spark, sf_dir, "documents"))
    return _built[key]


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return i.table(spark, sf_dir, "benchmark")


def vector_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items with the vector of equal id."""
    vectors = i.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    return questions(spark, sf_dir).select("item_id").join(vectors, "item_id")


def sparse_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.sparse_hits(_index(spark, sf_dir), questions(spark, sf_dir), "item_id", expand=False)


def dense_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.dense_hits(i.table(spark, sf_dir, "embeddings"), vector_questions(spark, sf_dir), "item_id")


def op_term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.term_frequencies(i.table(spark, sf_dir, "documents"))


def op_doc_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.doc_lengths(i.documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.postings(i.table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op_bm25_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.build(i.table(spark, sf_dir, "documents")).weights.select("term", "df", F.round("idf", 6).alias("idf"))


def op_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bm25.search(_index(spark, sf_dir), questions(spark, sf_dir), 10, ["item_id"])
    return found.withColumnRenamed("id", "doc_id")


def op_bm25_multiquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.sparse_hits(_index(spark, sf_dir), questions(spark, sf_dir), "item_id").withColumnRenamed("id", "doc_id")


def _searched(spark: SparkSession, sf_dir: str, metric: str, only=None) -> DataFrame:
    """Every vector whose id 20 divides, against all vectors (or those that a filter leaves)."""
    vectors = i.table(spark, sf_dir, "embeddings")
    asked = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return dense.top_k(vectors if only is None else vectors.filter(only), asked, 10, metric).withColumnRenamed("id", "vec_id")


def op_dense_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir, "cosine")


def op_dense_topk_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir, "dot")


def op_dense_topk_euclid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir, "euclid").withColumn("score", F.round(-F.col("score"), 6))


def op_dense_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir, "cosine", F.col("label").isin(1, 3, 5))


def op_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.rrf([dense_list(spark, sf_dir), sparse_list(spark, sf_dir)], "item_id").withColumnRenamed("id", "doc_id")


def op_rrf_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.rrf([dense_list(spark, sf_dir), sparse_list(spark, sf_dir)], "item_id", weights=[0.7, 0.3]).withColumnRenamed("id", "doc_id")


def op_merge_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.merge_results(dense_list(spark, sf_dir), sparse_list(spark, sf_dir), "item_id").withColumnRenamed("id", "doc_id")


def _confidence(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    lists = {"dense_list": dense_list(spark, sf_dir) if mode != "sparse" else None, "sparse_list": sparse_list(spark, sf_dir) if mode != "dense" else None}
    return fusion.with_confidence(questions(spark, sf_dir), retrieval.retrieve(mode, "item_id", **lists), "item_id", mode)


def op_confidence_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _confidence(spark, sf_dir, "dense")


def op_confidence_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _confidence(spark, sf_dir, "sparse")


def op_confidence_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _confidence(spark, sf_dir, "hybrid")


def op_refusal_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _confidence(spark, sf_dir, "hybrid").select("item_id", "confidence", refused("confidence", "results").alias("refused"))


KB_DOCS = ["src1", "src3", "src5", "src8", "src13"]


def knowledge_base(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(chunks, points) mapped from documents: a chunk a text, its source as its document, its language as category."""
    own = i.documents(spark, sf_dir)
    strategy = F.when(F.col("doc_id") % 2 == 0, "sentence").otherwise("fixed")
    none = F.lit(None).cast("string")
    chunks = own.select(F.concat(F.lit("doc-"), "doc_id").alias("chunk_id"), F.col("source").alias("doc_id"), strategy.alias("strategy"), F.col("lang").alias("category"), "text", none.alias("title"), none.alias("section"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"))
    return chunks, chunks.filter("text is not null").select("chunk_id", "doc_id", "strategy", letter_encoder(F.col("text")).alias("vector"))


def _kb_search(spark: SparkSession, sf_dir: str, mode: str, **options) -> DataFrame:
    chunks, points = knowledge_base(spark, sf_dir)
    found = retrieval.search_chunks(chunks, points, questions(spark, sf_dir), "item_id", letter_encoder, mode, "sentence", expand=False, **options)
    return found.select("item_id", "rank", F.col("id").alias("chunk_id"), "score", "retriever")


def op_kb_retrieve_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kb_search(spark, sf_dir, "dense")


def op_kb_retrieve_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kb_search(spark, sf_dir, "sparse", doc_ids=KB_DOCS)


def op_kb_retrieve_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kb_search(spark, sf_dir, "hybrid", doc_ids=KB_DOCS)


def op_eval_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A retrieval-only evaluation of every benchmark item over strategies and modes, summed up a cell."""
    chunks, points = knowledge_base(spark, sf_dir)
    asked = questions(spark, sf_dir).select(F.col("item_id").alias("id"), F.col("text").alias("question"), F.lit("").alias("ground_truth"), F.array(F.concat(F.lit("src"), F.col("item_id") % 20)).alias("expected_docs"), (F.col("item_id") % 5 != 0).alias("answerable"))
    rows = evaluating.run(chunks, points, asked, ["sentence", "fixed"], ["dense", "sparse", "hybrid"], letter_encoder, expand=False)
    return evaluating.summary(rows).select("strategy", "mode", "questions", "retrieval_hit_rate", "refusal_accuracy", F.round("avg_confidence", 3).alias("avg_confidence"))


INDEX = f"""t AS (SELECT doc_id, {i.sql_terms('text')} AS t FROM documents), dl AS (SELECT doc_id, len(t) AS dl FROM t),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM t) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    st AS (SELECT count(*)::DOUBLE AS n, avg(dl)::DOUBLE AS m FROM dl), rw AS (SELECT term, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS idf FROM df, st),
    iw AS (SELECT term, df, CASE WHEN idf < 0 THEN 0.25::DOUBLE * (SELECT avg(idf) FROM rw) ELSE idf END AS idf FROM rw)"""


def sparse_sql(name: str, questions: str, keys: str, limit: int) -> str:
    """Tables NAME_q and NAME: the best documents of the texts in ``questions``."""
    return f"""{name}_q AS (SELECT {keys}, term, count(*) AS times FROM (SELECT {keys}, unnest({i.sql_terms('text')}) AS term FROM ({questions})) GROUP BY ALL),
    {name}_s AS (SELECT {keys}, doc_id AS id, round(sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / m))), 6) AS score FROM {name}_q JOIN iw USING (term) JOIN tf USING (term) JOIN dl USING (doc_id), st GROUP BY ALL),
    {name} AS (SELECT {keys}, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, id) AS INTEGER) AS rank, id, score FROM {name}_s WHERE score > 0 QUALIFY rank <= {limit})"""


SCORE = {
    "cosine": "round(CASE WHEN list_dot_product(q.v, e.v) = 0 THEN 0 ELSE list_dot_product(q.v, e.v) / sqrt(list_dot_product(q.v, q.v)) / sqrt(list_dot_product(e.v, e.v)) END, 6)",
    "dot": "round(list_dot_product(q.v, e.v), 6)",
    "euclid": "round(list_distance(q.v, e.v), 6)",
}
VECTORS = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
DENSE = f"""{VECTORS}, ds AS (SELECT item_id, e.vec_id AS id, {SCORE['cosine']} AS score FROM (SELECT item_id, v FROM benchmark JOIN v ON vec_id = item_id) q, v e),
    d AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS INTEGER) AS rank, id, score FROM ds QUALIFY rank <= 20)"""
SPARSE = f"{INDEX}, {sparse_sql('s', 'SELECT item_id, text FROM benchmark', 'item_id', 20)}"
MERGED = f"""WITH {SPARSE}, {DENSE},
    m AS (SELECT item_id, id, round(coalesce(1 / (60::DOUBLE + d.rank), 0) + coalesce(1 / (60::DOUBLE + s.rank), 0), 9) AS score, d.rank AS dense_rank, d.score AS dense_score, s.rank AS sparse_rank, s.score AS sparse_score FROM d FULL JOIN s USING (item_id, id)),
    f AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS INTEGER) AS rank, id, score, CASE WHEN dense_rank IS NULL THEN 'sparse' WHEN sparse_rank IS NULL THEN 'dense' ELSE 'hybrid' END AS retriever, dense_rank, dense_score, sparse_rank, sparse_score FROM m QUALIFY rank <= 5)"""


def dense_sql(metric: str, where: str = "true") -> str:
    order = "score" if metric == "euclid" else "score DESC"
    scored = f"SELECT q.vec_id AS query_id, e.vec_id, {SCORE[metric]} AS score FROM v q, v e WHERE q.vec_id % 20 = 0 AND {where.replace('label', 'e.label')}"
    return f"WITH {VECTORS} SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {order}, vec_id) AS INTEGER) AS rank, vec_id, score FROM ({scored}) QUALIFY rank <= 10"


def rrf_sql(dense_weight: float, sparse_weight: float) -> str:
    return f"""WITH {SPARSE}, {DENSE}, u AS (SELECT item_id, id, {dense_weight}::DOUBLE / (60 + rank) AS p FROM d UNION ALL SELECT item_id, id, {sparse_weight}::DOUBLE / (60 + rank) FROM s),
        f AS (SELECT item_id, id, round(sum(p), 9) AS score FROM u GROUP BY ALL) SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS doc_id, score FROM f"""


def confidence_sql(mode: str) -> str:
    dense_part = "least(1::DOUBLE, greatest(0::DOUBLE, (max(score) - 0.70::DOUBLE) / 0.25::DOUBLE))"
    if mode == "dense":
        return f"WITH {DENSE} SELECT b.item_id, count(score) AS results, coalesce(round({dense_part}, 4), 0) AS confidence FROM benchmark b LEFT JOIN (FROM d WHERE rank <= 5) USING (item_id) GROUP BY b.item_id"
    if mode == "sparse":
        return f"WITH {SPARSE} SELECT b.item_id, count(score) AS results, coalesce(round(max(score) / (max(score) + 12::DOUBLE), 4), 0) AS confidence FROM benchmark b LEFT JOIN (FROM s WHERE rank <= 5) USING (item_id) GROUP BY b.item_id"
    strength = f"CASE WHEN max(dense_score) IS NOT NULL THEN {dense_part.replace('max(score)', 'max(dense_score)')} ELSE max(sparse_score) / (max(sparse_score) + 12::DOUBLE) END"
    return f"{MERGED} SELECT b.item_id, count(score) AS results, coalesce(round(0.7::DOUBLE * {strength} + 0.3::DOUBLE * count(*) FILTER (WHERE retriever = 'hybrid') / nullif(count(score), 0), 4), 0) AS confidence FROM benchmark b LEFT JOIN f USING (item_id) GROUP BY b.item_id"


def expansion_sql(x: str) -> str:
    """Variants as a list: built one by one, an earlier equal one (but for case) drops the later."""
    own = i.sql_strip(x)
    forms = own
    for word, sign in lx.SECTION_FORMS:
        forms = f"regexp_replace({forms}, '(?i){word}', {i.q(sign)}, 'g')"
    frame = i.q(rf"(?i)^(?:{lx.QUESTION_WORDS}){lx.WS}+(?:(?:{lx.FRAME_WORDS}){lx.WS}+)*")
    bare = f"trim(regexp_replace({own}, {frame}, ''), ' ?')"
    keys = f"array_to_string({i.sql_terms(x)}, ' ')"
    return f"""(SELECT list(e ORDER BY k) FROM (SELECT e, k FROM (SELECT unnest([{forms}, {bare}, {keys}]) AS e, unnest([1, 2, 3]) AS k)
        WHERE {i.sql_strip('e')} <> '' AND lower(e) <> lower({own}) AND NOT (k = 1 AND e = {own}) AND NOT (k = 2 AND lower(e) = trim(lower({own}), ' ?'))
        QUALIFY row_number() OVER (PARTITION BY lower(e) ORDER BY k) = 1))"""


KB_LETTERS = "[" + ", ".join(f"CAST(len(regexp_extract_all(text, '{g}')) AS DOUBLE)" for g in ["[aeiou]", "[bcdfg]", "[hjklm]", "[npqrs]", "[tvwxyz]", "[0-9]", "[ ]", "[A-Z]"]) + "]"


def kb_sql(odd: int = 0, docs: list[str] | None = None) -> str:
    """Tables s, d (the two candidate lists) and f (fused) over the chunks of one strategy, before the final SELECT."""
    only = f"src IN ({', '.join(map(i.q, docs))})" if docs else "true"
    sparse = sparse_sql("s", "SELECT item_id, text FROM benchmark", "item_id", 20).replace("JOIN dl USING (doc_id), st", f"JOIN dl USING (doc_id) JOIN (SELECT doc_id FROM kb WHERE {only}) USING (doc_id), st")
    return f"""WITH kb AS (SELECT 'doc-' || doc_id AS doc_id, source AS src, text FROM documents WHERE doc_id % 2 = {odd}), {INDEX.replace('FROM documents', 'FROM kb')}, {sparse},
        kv AS (SELECT doc_id AS id, {KB_LETTERS} AS v FROM kb WHERE text IS NOT NULL AND {only}), kq AS (SELECT item_id, {KB_LETTERS} AS v FROM benchmark),
        ds AS (SELECT item_id, id, {SCORE['cosine'].replace('e.v', 'kv.v').replace('q.v', 'kq.v')} AS score FROM kq, kv),
        d AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS INTEGER) AS rank, id, score FROM ds QUALIFY rank <= 20), {MERGED[MERGED.index('m AS ('):]}"""


def _cell_sql(odd: int, strategy: str, mode: str) -> str:
    """One cell of the grid: found, sure and right, summed up over the questions."""
    dense_part = "least(1::DOUBLE, greatest(0::DOUBLE, (max(dense_score) - 0.70::DOUBLE) / 0.25::DOUBLE))"
    sparse_part = "max(sparse_score) / (max(sparse_score) + 12::DOUBLE)"
    r = {"dense": "SELECT item_id, id, score AS dense_score, NULL::DOUBLE AS sparse_score FROM d WHERE rank <= 5", "sparse": "SELECT item_id, id, NULL::DOUBLE AS dense_score, score AS sparse_score FROM s WHERE rank <= 5", "hybrid": "SELECT item_id, id, dense_score, sparse_score FROM f"}[mode]
    strength = f"CASE WHEN max(dense_score) IS NOT NULL THEN {dense_part} ELSE {sparse_part} END"
    sure = f"0.7::DOUBLE * {strength} + 0.3::DOUBLE * count(*) FILTER (WHERE dense_score IS NOT NULL AND sparse_score IS NOT NULL) / nullif(count(r.id), 0)" if mode == "hybrid" else strength
    return f"""SELECT '{strategy}' AS strategy, '{mode}' AS mode, count(*) AS questions, round(avg(CAST(hit AS INTEGER)), 4) AS retrieval_hit_rate,
        round(avg(CAST(CASE WHEN item_id % 5 <> 0 THEN NOT refused ELSE refused END AS INTEGER)), 4) AS refusal_accuracy, round(round(avg(confidence), 4), 3) AS avg_confidence FROM (
        SELECT *, n = 0 OR confidence < 0.3::DOUBLE AS refused FROM ({kb_sql(odd)} SELECT b.item_id, count(r.id) AS n, coalesce(round({sure}, 4), 0) AS confidence, coalesce(bool_or(src = 'src' || b.item_id % 20), false) AS hit
            FROM benchmark b LEFT JOIN ({r}) r USING (item_id) LEFT JOIN kb ON kb.doc_id = r.id GROUP BY b.item_id))"""


SQL = {
    "op_kb_retrieve_dense": f"{kb_sql()} SELECT item_id, rank, id AS chunk_id, score, 'dense' AS retriever FROM d WHERE rank <= 5",
    "op_kb_retrieve_sparse": f"{kb_sql(docs=KB_DOCS)} SELECT item_id, rank, id AS chunk_id, score, 'sparse' AS retriever FROM s WHERE rank <= 5",
    "op_kb_retrieve_hybrid": f"{kb_sql(docs=KB_DOCS)} SELECT item_id, rank, id AS chunk_id, score, retriever FROM f",
    "op_eval_run": " UNION ALL ".join(_cell_sql(odd, strategy, mode) for odd, strategy in enumerate(["sentence", "fixed"]) for mode in ("dense", "sparse", "hybrid")),
    "op_term_df": f"WITH {INDEX} SELECT term, df FROM df",
    "op_doc_len": f"WITH {INDEX} SELECT doc_id, CAST(dl AS INTEGER) AS dl FROM dl",
    "op_postings": f"WITH {INDEX} SELECT doc_id, term, tf, CAST(dl AS INTEGER) AS dl FROM tf JOIN dl USING (doc_id)",
    "op_bm25_idf": f"WITH {INDEX} SELECT term, df, round(idf, 6) AS idf FROM iw",
    "op_bm25_topk": f"WITH {INDEX}, {sparse_sql('s', 'SELECT item_id, text FROM benchmark', 'item_id', 10)} SELECT item_id, rank, id AS doc_id, score FROM s",
    "op_bm25_multiquery": f"""WITH {INDEX}, x AS (SELECT item_id, text, {expansion_sql('text')} AS e FROM benchmark),
        q AS (SELECT item_id, 0 AS variant, text FROM x UNION ALL SELECT item_id, unnest(generate_series(1, len(e))), unnest(e) FROM x WHERE e IS NOT NULL),
        {sparse_sql('s', 'FROM q', 'item_id, variant', 20)}, o AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY item_id, id ORDER BY variant, rank) = 1)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, variant, rank) AS INTEGER) AS rank, id AS doc_id, score FROM o QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, variant, o.rank) <= 20""",
    "op_dense_topk_cosine": dense_sql("cosine"),
    "op_dense_topk_dot": dense_sql("dot"),
    "op_dense_topk_euclid": dense_sql("euclid"),
    "op_dense_filtered": dense_sql("cosine", "label IN (1, 3, 5)"),
    "op_rrf": rrf_sql(1.0, 1.0),
    "op_rrf_weighted": rrf_sql(0.7, 0.3),
    "op_merge_labels": f"{MERGED} SELECT item_id, rank, id AS doc_id, score, retriever, dense_rank, dense_score, sparse_rank, sparse_score FROM f",
    "op_confidence_dense": confidence_sql("dense"),
    "op_confidence_sparse": confidence_sql("sparse"),
    "op_confidence_hybrid": confidence_sql("hybrid"),
    "op_refusal_gate": f"SELECT item_id, confidence, results = 0 OR confidence < 0.3::DOUBLE AS refused FROM ({confidence_sql('hybrid')})",
}
