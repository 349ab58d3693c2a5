"""Ingestion: files to documents, pages, chunks and vectors, each step skipping what is there already."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velith.functions.answers import preview
from velith.functions.ids import point_id
from velith.operators import store
from velith.operators.chunking import letter_encoder, chunker
from velith.operators.statistics import document_totals, has_all_chunks, ingest_counters, ingest_status
from velith.sources.corpora import described
from velith.sources.files import Reader, hashed, parsed, plain_pages, read_pages
from velith.sources.logs import Logs
from velith.sources.scratch import materialise
from velith.sources.snapshots import SnapshotTable

DOCUMENTS = "doc_id string, title string, source_url string, filename string, language string, category string, content_hash string, page_count long, char_count long, table_count long, ingested_at timestamp, updated_at timestamp"
PAGES = "doc_id string, page_number int, text string, section string, char_count int, has_tables boolean"
CHUNKS = "doc_id string, chunk_index int, chunk_id string, text string, token_count int, page_start int, page_end int, section string, content_hash string, embedded boolean, strategy string"
POINTS = "point_id string, chunk_id string, doc_id string, title string, category string, language string, strategy string, chunk_index int, section string, page_start int, page_end int, preview string, vector array<float>"


class KnowledgeBase:
    """The tables of a knowledge base and its logs under one folder; all but the logs are cut into buckets by document."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.documents = SnapshotTable(spark, f"{path}/documents", DOCUMENTS, key="doc_id")
        self.pages = SnapshotTable(spark, f"{path}/pages", PAGES, key="doc_id")
        self.chunks = SnapshotTable(spark, f"{path}/chunks", CHUNKS, ("strategy",), key="doc_id")
        self.points = SnapshotTable(spark, f"{path}/points", POINTS, key="doc_id")

        self.logs = Logs(spark, path)

    def delete(self, gone: DataFrame) -> None:
        """Documents by id, with their pages, chunks and vectors; dependants first, so a broken run leaves no orphans."""
        for table in (self.points, self.chunks, self.pages, self.documents):
            table.change(lambda old: store.without(old, gone, "doc_id"), touched=gone)


def ingest(base: KnowledgeBase, files: DataFrame, entries: DataFrame, strategies: list[str], reader: Reader = plain_pages, encode: Callable[[Column], Column] = letter_encoder, corpus: str = "") -> dict[str, int]:
    """Take in new and changed files; returns the counters: seen, new, changed, skipped, pages, chunks, failures.

    The hash is looked at before anything is parsed; a file whose hash is known and that has chunks of every strategy
    is skipped.  A file that the reader can't read is counted and left out, the others go on.  Documents are written last: a
    run that breaks off is taken up again by the next one.  The run's beginning, its end and its counters are logged.
    """
    run = base.logs.start_run(corpus, ",".join(strategies))
    try:
        counters = _ingest(base, files, entries, strategies, reader, encode)
    except Exception as problem:
        base.logs.finish_run(run, {}, str(problem))
        raise
    base.logs.finish_run(run, counters)
    return counters


def _ingest(base: KnowledgeBase, files: DataFrame, entries: DataFrame, strategies: list[str], reader: Reader, encode: Callable[[Column], Column]) -> dict[str, int]:
    named = described(hashed(files), entries)
    known = base.documents.read()
    status = ingest_status(named, known, has_all_chunks(known, base.chunks.read(), strategies))
    counters = {**ingest_counters(status).first().asDict(), "pages": 0, "chunks": 0, "failures": 0}
    if not counters["new"] + counters["changed"]:
        return counters
    tried = named.join(status.filter("status != 'skipped'").select("doc_id"), "doc_id", "left_semi")
    raw = materialise(read_pages(tried.select("doc_id", "content"), reader), "raw-pages")
    failed = materialise(raw.filter("error is not null").select("doc_id").distinct(), "failed-files")
    fresh = tried.join(failed, "doc_id", "left_anti")
    pages = parsed(raw.join(failed, "doc_id", "left_anti"))
    ids, hashes = fresh.select("doc_id"), fresh.select("doc_id", "content_hash")
    base.pages.change(lambda old: store.replace_groups(old, pages, ["doc_id"]), touched=ids)
    stored = base.pages.read().join(ids, "doc_id", "left_semi")
    for strategy in strategies:
        options = {"encoder": encode} if strategy == "semantic" else {}
        made = chunker(strategy, **options)(stored).join(hashes, "doc_id").withColumn("embedded", F.lit(False))
        base.chunks.change(lambda old, made=made: store.replace_groups(old, made, ["doc_id", "strategy"]), touched=ids)
    now = F.current_timestamp()
    rows = fresh.join(document_totals(pages), "doc_id", "left").select(
        "doc_id", "title", F.col("url").alias("source_url"), "filename", "language", "category", "content_hash",
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("page_count", "char_count", "table_count")), now.alias("ingested_at"), now.alias("updated_at"),
    )
    base.documents.change(lambda old: store.upsert(old, rows, ["doc_id"], keep=("ingested_at",)), touched=ids)
    own = base.chunks.read().filter(F.col("strategy").isin(strategies)).join(ids, "doc_id", "left_semi")
    return {**counters, "pages": stored.count(), "chunks": own.count(), "failures": failed.count()}


def points(chunks: DataFrame, encode: Callable[[Column], Column]) -> DataFrame:
    """Vectors of chunks with what a hit shows without a look at the chunk; ids depend on the chunk alone."""
    shown = [c for c in ("title", "category", "language", "chunk_index", "section", "page_start", "page_end") if c in chunks.columns]
    return chunks.select(point_id("chunk_id").alias("point_id"), "chunk_id", "doc_id", "strategy", *shown, preview("text").alias("preview"), encode(F.col("text")).alias("vector"))


def same_dimension(new: DataFrame, old: DataFrame, vector_col: str = "vector") -> None:
    """Refuse vectors that differ in length among themselves or from those stored already."""
    sizes = {r["d"] for df in (new, old) for r in df.select(F.size(vector_col).alias("d")).distinct().limit(2).collect()}
    if len(sizes) > 1:
        raise ValueError(f"vectors of different dimensions can't stand in one collection: {sorted(sizes)}; recreate it")


def embed(base: KnowledgeBase, encode: Callable[[Column], Column], strategy: str | None = None, recreate: bool = False) -> dict[str, int]:
    """Vectors for chunks that have none; vectors of chunks that are gone are removed; returns how many of each.

    One strategy's vectors are committed before the next one's are made, so a run that breaks off is taken up where it was.
    """
    every = base.chunks.read()
    kept, orphans = store.prune(base.points.read(), every, "chunk_id")
    pruned = orphans.count()
    if recreate:
        kept = kept.filter(F.lit(False) if strategy is None else F.col("strategy") != strategy)
    if pruned or recreate:
        base.points.write(kept)
    names = [strategy] if strategy else sorted(r["strategy"] for r in every.select("strategy").distinct().collect())  # a handful
    shown = base.documents.read().select("doc_id", "title", "category", "language")
    embedded = 0
    for name in names:
        there = base.points.read()
        chunks = every.filter(F.col("strategy") == name)
        todo = chunks.join(there.select("chunk_id"), "chunk_id", "left_anti").join(shown, "doc_id", "left")
        made = materialise(points(todo, encode), "new-points")
        same_dimension(made, there)
        embedded += made.count()
        base.points.change(lambda old, made=made: store.last_wins(old.unionByName(made), ["point_id"], "chunk_id"), touched=made)
        base.chunks.change(lambda old, own=there.select("chunk_id").union(made.select("chunk_id")): store.mark(old, own, "chunk_id", "embedded", F.lit(True)), touched=chunks)
    return {"embedded": embedded, "pruned": pruned}
