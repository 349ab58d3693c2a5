"""Corpus pipeline: raw documents to token ids.

1. quality      documents that the positive-unlabelled classifier rejects go;
2. line_dedup   later copies of repeated line runs of 50 words and more are cut out; a document of which nothing is left goes;
3. near_dedup   of each group of near-duplicates (five-word shingles, Jaccard 0.8 or more) the least doc_id stays;
4. decontaminate  documents in which ten consecutive words of a benchmark item occur go;
5. encode       SentencePiece ids with digests, and the decoded text's.

Each stage takes (spark, docs, sf_dir) and works on everything that the stage before kept; all but the last return the
columns of ``documents``.  Null texts are empty texts: they pass every filter that finds nothing in them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from velith.llm import decontamination, line_dedup, near_dedup, quality, sentencepiece_codec
from velith.llm.common import materialise, table


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.clean(docs, min_words=50)


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs, shingle=5, percent=80)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def stage_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality", stage_quality),
    ("line_dedup", stage_line_dedup),
    ("near_dedup", stage_near_dedup),
    ("decontaminate", stage_decontaminate),
    ("encode", stage_encode),
]

#: The first stage is a trained classifier, which SQL can't express; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
