"""Files as rows: scan, content hash, page reader seam, JSON question sets."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velith.functions.ids import content_hash
from velith.functions.text import clean_text, first_section, table_to_markdown
from velith.operators.chunking import carry_sections

#: A reader takes a file's bytes and yields, page by page, its raw text and its tables as rows of cells.
Reader = Callable[[bytes], Iterable[tuple[str, list[list[list[str | None]]]]]]
MAGIC = {"pdf": b"%PDF"}


def scan(spark: SparkSession, folder: str, pattern: str = "*.pdf", limit: int | None = None) -> DataFrame:
    """(path, filename, length, content): files of a folder that aren't empty, the first ``limit`` by path if it is given."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).filter("length > 0")
    if limit is not None:
        found = found.orderBy("path").limit(limit)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "length", "content")


def with_magic(files: DataFrame, magic: bytes = MAGIC["pdf"]) -> DataFrame:
    """Files that start with these bytes."""
    return files.filter(F.substring("content", 1, len(magic)) == F.lit(bytearray(magic)))


def hashed(files: DataFrame) -> DataFrame:
    """With content_hash, the gate of incremental ingestion; the bytes go no further than this projection if they aren't asked for."""
    return files.withColumn("content_hash", content_hash("content"))


def plain_pages(content: bytes) -> Iterable[tuple[str, list[list[list[str | None]]]]]:
    """The built-in reader: UTF-8 text with form feeds between pages and no tables."""
    for page in content.decode("utf-8", "replace").split("\f"):
        yield page, []


def read_pages(files: DataFrame, reader: Reader = plain_pages, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, page_number, raw, tables, error) with one row a page; the reader runs on the executors, one file at a time.

    A file that the reader fails on is one row with the error and no page; the other files aren't touched by it.
    """

    def run(frames):
        for frame in frames:
            for row in frame.itertuples(index=False):
                try:
                    pages = [(k, raw, tables, None) for k, (raw, tables) in enumerate(reader(bytes(row.content)), 1)]
                except Exception as problem:
                    pages = [(0, None, None, f"{type(problem).__name__}: {problem}")]
                out = pd.DataFrame(pages, columns=["page_number", "raw", "tables", "error"])
                for key in keys:
                    out[key] = getattr(row, key)
                yield out[[*keys, "page_number", "raw", "tables", "error"]]

    kinds = ", ".join(f"{k} {files.schema[k].dataType.simpleString()}" for k in keys)
    return files.select(*keys, "content").mapInPandas(run, f"{kinds}, page_number int, raw string, tables array<array<array<string>>>, error string")


def parsed(pages: DataFrame) -> DataFrame:
    """Clean pages: text with tables appended as Markdown, own or inherited section, empty pages dropped with their number kept."""
    tables = F.filter(F.transform(F.coalesce("tables", F.array().cast("array<array<array<string>>>")), table_to_markdown), lambda t: t != "")
    body = F.array_join(F.filter(F.concat(F.array(clean_text("raw")), tables), lambda t: t != ""), "\n\n")
    out = pages.select("doc_id", "page_number", first_section("raw").alias("section"), body.alias("text"), (F.size(tables) > 0).alias("has_tables"), F.size(tables).alias("table_count"))
    return carry_sections(out.filter("text != ''")).withColumn("char_count", F.length("text"))


def question_set(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a JSON file with a ``questions`` array."""
    kind = "struct<questions:array<struct<id:string,question:string,ground_truth:string,expected_docs:array<string>,language:string,answerable:boolean,note:string>>>"
    raw = spark.read.schema(kind[7:-1].replace("questions:", "questions ", 1)).option("multiLine", True).json(path)
    return raw.select(F.explode("questions").alias("q")).select("q.*").withColumn("answerable", F.coalesce("answerable", F.lit(True)))
