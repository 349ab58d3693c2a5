"""The headline query: what each benchmark item finds, how sure that is, and whether to answer from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velith.functions.answers import citation, refused
from velith.operators import fusion
from velith.plans.answering import found_in
from velith.plans.catalog import inputs as i
from velith.plans.catalog import retrieval as r
from velith.sources.scratch import materialise


def hybrid_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item and rank: the document, its label, score and citation, the item's confidence and whether it is refused."""
    results = materialise(fusion.merge_results(r.dense_list(spark, sf_dir), r.sparse_list(spark, sf_dir), "item_id"), "results")
    titles = found_in(i.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "lang"), results)
    joined = fusion.sure(results, "item_id", "hybrid").join(titles, "id", "left")
    one = F.lit(1)
    return joined.select("item_id", "rank", F.col("id").alias("doc_id"), "retriever", "score", citation("source", F.col("id").cast("string"), "lang", one, one).alias("citation"), "confidence", refused("confidence", "results").alias("refused"))


SQL = f"""{r.MERGED}, c AS ({r.confidence_sql('hybrid').removeprefix(r.MERGED)})
    SELECT item_id, rank, id AS doc_id, retriever, score, coalesce(source, CAST(id AS VARCHAR)) || coalesce(', ' || lang, '') || ', p. 1' AS citation, confidence, results = 0 OR confidence < 0.3::DOUBLE AS refused
    FROM f JOIN c USING (item_id) LEFT JOIN documents ON doc_id = id"""
