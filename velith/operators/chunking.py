"""Pages to sentences, and the three chunkers.

Pages are rows (doc_id, page_number, section, text).  A chunk is built from a document's own rows only, so every step
groups by doc_id; order-dependent packing folds integers (token counts) into ranges and slices the sentences afterwards.

Chunks: doc_id, strategy, chunk_index, chunk_id, text, token_count, page_start, page_end, section.

Defined cases: null and blank texts give no piece and no chunk; an empty table gives an empty result; other columns are
not looked at; rows that repeat doc_id and page_number are ordered by text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velith.functions import lexicon as lx
from velith.functions.ids import chunk_id
from velith.functions.text import count_tokens, detect_section, first_line, split_sentences, words
from velith.functions.vectors import distance, unit_size

CHUNK = ["doc_id", "strategy", "chunk_index", "chunk_id", "text", "token_count", "page_start", "page_end", "section"]
Encoder = Callable[[Column], Column]
#: Tokens of a text; ``sources.models.token_counter`` counts those of a tokenizer file, the default counts at white space.
Counter = Callable[[Column], Column]


def as_pages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents without pages as documents of one page."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.lit(1).alias("page_number"), F.lit(None).cast("string").alias("section"), F.col(text).alias("text"))


def carry_sections(pages: DataFrame) -> DataFrame:
    """``section`` of each page, taken on from earlier pages of the document where a page has none."""
    order = Window.partitionBy("doc_id").orderBy("page_number", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return pages.withColumn("section", F.last(F.when(F.col("section") != "", F.col("section")), ignorenulls=True).over(order))


def _sentences(pages: DataFrame, count: Counter) -> DataFrame:
    """(doc_id, page_number, place, pos, text, event, n): sentences in the order of place and pos, with the section one starts.

    Pages are numbered before they are cut, so a sentence carries its page's place and not the page's text.  The patterns of
    headings stand in a lambda: few sentences need them, and compiled for all of them they make a method too large for the JIT.
    """
    place = Window.partitionBy("doc_id").orderBy("page_number", "text")
    placed = pages.select("doc_id", "page_number", "section", "text", F.rank().over(place).alias("place"))
    one = placed.select("doc_id", "page_number", "section", "place", F.posexplode_outer(split_sentences("text")).alias("pos", "sentence")).filter("pos is not null")
    heading = F.when(F.substring("sentence", 1, 1).rlike(lx.HEADING_START), F.get(F.transform(F.array(first_line("sentence")), detect_section), F.lit(0)))
    start = F.when((F.col("pos") == 0) & (F.col("section") != ""), F.col("section"))
    return one.select("doc_id", "page_number", "place", "pos", F.col("sentence").alias("text"), F.coalesce(heading, start).alias("event"), count(F.col("sentence")).alias("n"))


def _numbered(sentences: DataFrame, *more: str) -> DataFrame:
    """Sentences with their number and the section they are in."""
    order = Window.partitionBy("doc_id").orderBy("place", "pos")
    return sentences.select(
        "doc_id",
        (F.row_number().over(order) - 1).alias("ix"),
        "text",
        F.col("page_number").alias("page"),
        F.last("event", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("section"),
        "n",
        *more,
    )


def pages_to_sentences(pages: DataFrame, count: Counter = count_tokens) -> DataFrame:
    """(doc_id, ix, text, page, section, n): sentences with their page, section and token count.

    A page starts in its own section if it has one; a sentence whose first line is a heading starts that section.
    """
    return _numbered(_sentences(pages, count))


def stamped(chunks: DataFrame, strategy: str) -> DataFrame:
    """Strategy name and chunk id on chunks that have the other columns."""
    named = chunks.withColumn("strategy", F.lit(strategy))
    return named.withColumn("chunk_id", chunk_id("doc_id", "strategy", "chunk_index", "text")).select(*CHUNK)


def fixed_chunks(pages: DataFrame, size: int = lx.FIXED_TOKENS, overlap: int = lx.FIXED_OVERLAP) -> DataFrame:
    """Windows of ``size`` tokens that start every ``size - overlap`` tokens, until one reaches the end."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap smaller than it")
    page = F.struct(F.col("page_number").alias("page"), "text", "section", words("text").alias("w"))
    docs = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(page)).alias("p"))
    docs = docs.select("doc_id", "p", F.flatten(F.transform("p", lambda x: F.coalesce(x["w"], F.array().cast("array<string>")))).alias("w"))
    ends = F.transform("p", lambda x, i: F.aggregate(F.slice("p", 1, i + 1), F.lit(0), lambda acc, y: acc + F.coalesce(F.size(y["w"]), F.lit(0))))
    docs = docs.select("doc_id", "w", F.zip_with("p", ends, lambda x, e: F.struct(x["page"].alias("page"), x["section"].alias("section"), (e - F.size(x["w"])).alias("from"), e.alias("to"))).alias("p"))
    starts = F.filter(F.sequence(F.lit(0), F.size("w") - 1, F.lit(size - overlap)), lambda s: (s == 0) | (s + overlap < F.size("w")))
    cut = docs.filter(F.size("w") > 0).select("doc_id", "w", "p", F.posexplode(starts).alias("chunk_index", "at"))
    text = F.slice("w", F.col("at") + 1, F.lit(size))
    inside = F.filter("p", lambda x: (x["to"] > F.col("at")) & (x["from"] < F.col("at") + size) & (x["to"] > x["from"]))
    section = F.get(F.filter(F.transform(inside, lambda x: x["section"]), lambda s: s.isNotNull() & (s != "")), F.lit(0))
    out = cut.select("doc_id", "chunk_index", F.array_join(text, " ").alias("text"), F.size(text).alias("token_count"), F.array_min(F.transform(inside, lambda x: x["page"])).alias("page_start"), F.array_max(F.transform(inside, lambda x: x["page"])).alias("page_end"), section.alias("section"))
    return stamped(out, "fixed")


def _packed(pieces: DataFrame, ranges: Column, strategy: str, count: Counter = count_tokens) -> DataFrame:
    """Chunks from documents (doc_id, s: sorted pieces) and an expression for their (from, to) ranges.

    Tokens at white space are those of the pieces, as blanks join them; other counters see the chunk's text.
    """
    cols = [F.col(f"s.{c}").alias(c) for c in ("text", "page", "section", "n")]
    each = pieces.select("doc_id", *cols, F.posexplode(ranges).alias("chunk_index", "r"))
    part = lambda c: F.slice(c, F.col("r.from") + 1, F.col("r.to") - F.col("r.from")).alias(c)
    own = each.select("doc_id", "chunk_index", F.array_join(part("text"), " ").alias("text"), part("page"), part("section"), part("n"))
    section = F.get(F.filter("section", lambda v: v.isNotNull()), F.lit(0))
    tokens = F.aggregate("n", F.lit(0), lambda a, v: a + v) if count is count_tokens else count(F.col("text"))
    out = own.select("doc_id", "chunk_index", "text", F.array_min("page").alias("page_start"), F.array_max("page").alias("page_end"), section.alias("section"), tokens.alias("token_count"))
    return stamped(out, strategy)


def sentence_ranges(counts: Column, budget: int, overlap: int) -> Column:
    """(from, to) ranges of greedy packing.

    A sentence over the budget closes the open chunk and stands alone, and nothing is carried over it; otherwise a chunk
    that would overflow is closed and the next one opens with its last ``overlap`` sentences, whatever they hold.
    """
    none = F.array().cast("array<struct<from:int,to:int>>")
    state = F.struct(F.lit(0).alias("start"), F.lit(0).alias("total"), none.alias("out"))
    span = lambda a, b: F.struct(a.cast("int").alias("from"), b.cast("int").alias("to"))

    def step(acc: Column, x: Column) -> Column:
        i, n = x["i"], x["n"]
        open_ = i > acc["start"]
        closed = F.when(open_, F.array_append(acc["out"], span(acc["start"], i))).otherwise(acc["out"])
        back = F.greatest(acc["start"], i - overlap)
        carried = reduce(lambda a, k: a + F.when(i - k >= back, F.get(counts, i - k)).otherwise(0), range(1, overlap + 1), F.lit(0))
        alone = F.struct((i + 1).alias("start"), F.lit(0).alias("total"), F.array_append(closed, span(i, i + 1)).alias("out"))
        over = F.struct(back.alias("start"), (carried + n).alias("total"), closed.alias("out"))
        more = F.struct(acc["start"].alias("start"), (acc["total"] + n).alias("total"), acc["out"].alias("out"))
        return F.when(n > budget, alone).when((acc["total"] + n > budget) & open_, over).otherwise(more)

    end = lambda acc: F.when(acc["start"] < F.size(counts), F.array_append(acc["out"], span(acc["start"], F.size(counts)))).otherwise(acc["out"])
    return F.aggregate(F.transform(counts, lambda n, i: F.struct(i.alias("i"), n.alias("n"))), state, step, end)


def _documents(pieces: DataFrame, *more: str) -> DataFrame:
    item = F.struct("ix", "text", "page", "section", "n", *more)
    return pieces.groupBy("doc_id").agg(F.sort_array(F.collect_list(item)).alias("s"))


def sentence_chunks(pages: DataFrame, budget: int = lx.SENTENCE_TOKENS, overlap: int = lx.SENTENCE_OVERLAP, count: Counter = count_tokens) -> DataFrame:
    """Whole sentences packed greedily up to a budget of tokens."""
    docs = _documents(pages_to_sentences(pages, count)).withColumn("counts", F.col("s.n"))
    return _packed(docs, sentence_ranges(F.col("counts"), budget, overlap), "sentence", count)


def semantic_ranges(items: Column, budget: int, least: int, threshold: Column) -> Column:
    """(from, to) ranges cut at topic shifts: a far sentence after ``least`` of them, or one that would overflow."""
    none = F.array().cast("array<struct<from:int,to:int>>")
    state = F.struct(F.lit(0).alias("start"), F.lit(0).alias("total"), none.alias("out"))
    span = lambda a, b: F.struct(a.cast("int").alias("from"), b.cast("int").alias("to"))

    def step(acc: Column, x: Column) -> Column:
        far = (x["d"] >= threshold) & (x["i"] - acc["start"] >= least)
        cut = (x["i"] > acc["start"]) & (F.coalesce(far, F.lit(False)) | (acc["total"] + x["n"] > budget))
        new = F.struct(x["i"].alias("start"), x["n"].alias("total"), F.array_append(acc["out"], span(acc["start"], x["i"])).alias("out"))
        return F.when(cut, new).otherwise(F.struct(acc["start"].alias("start"), (acc["total"] + x["n"]).alias("total"), acc["out"].alias("out")))

    size = F.size(items)
    folded = F.aggregate(items, state, step, lambda acc: F.array_append(acc["out"], span(acc["start"], size)))
    return F.when(size <= least, F.array(span(F.lit(0), size))).otherwise(folded)


def with_distances(pieces: DataFrame, encoder: Encoder, *order: str) -> DataFrame:
    """Pieces with ``d``: the distance of each sentence to the one before it (null for the first), to nine decimals."""
    place = Window.partitionBy("doc_id").orderBy(*(order or ("ix",)))
    sized = pieces.withColumn("v", encoder(F.col("text"))).withColumn("size", unit_size("v"))
    both = sized.withColumn("before", F.lag(F.struct("v", "size")).over(place))
    far = F.round(distance("before.v", "v", F.col("before.size"), F.col("size")), 9)
    return both.withColumn("d", F.when(F.col("before").isNotNull(), far)).drop("v", "size", "before")


def semantic_chunks(pages: DataFrame, encoder: Encoder, budget: int = lx.SEMANTIC_TOKENS, percentile: float = lx.SEMANTIC_PERCENTILE, least: int = lx.SEMANTIC_SENTENCES, count: Counter = count_tokens) -> DataFrame:
    """Sentences packed until the distance to the next is at or over the document's percentile of distances."""
    far = _numbered(with_distances(_sentences(pages, count), encoder, "place", "pos"), "d")
    item = F.struct("ix", "text", "page", "section", "n", "d")
    docs = far.groupBy("doc_id").agg(F.sort_array(F.collect_list(item)).alias("s"), F.round(F.percentile("d", percentile), 9).alias("threshold"))
    docs = docs.withColumn("items", F.transform("s", lambda x, i: F.struct(i.alias("i"), x["n"].alias("n"), x["d"].alias("d"))))
    return _packed(docs, semantic_ranges(F.col("items"), budget, least, F.col("threshold")), "semantic", count)


def letter_encoder(text: Column) -> Column:
    """A deterministic stand-in for a sentence encoder: counts of eight letter classes."""
    groups = ["aeiou", "bcdfg", "hjklm", "npqrs", "tvwxyz", "0123456789", " ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]

    @F.arrow_udf("array<double>")
    def encode(texts: pa.Array) -> pa.Array:
        of = np.full(256, len(groups), np.int64)
        for k, g in enumerate(groups):
            of[list(g.encode())] = k
        texts = texts.cast(pa.large_string())
        _, ends, data = texts.buffers()
        ends = np.frombuffer(ends, np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
        bytes_ = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]
        width = len(groups) + 1
        row = np.repeat(np.arange(len(texts)) * width, np.diff(ends))
        found = np.bincount(row + of[bytes_], minlength=len(texts) * width).reshape(-1, width)[:, :-1].astype(float)
        empty = np.repeat(np.asarray(texts.is_null()), len(groups))
        at = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(groups))
        return pa.ListArray.from_arrays(at, pa.array(found.ravel(), mask=empty))

    return encode(text)


def chunker(strategy: str, encoder: Encoder | None = None, **options) -> Callable[[DataFrame], DataFrame]:
    """A chunker by name; the semantic one needs an encoder."""
    if strategy == "fixed":
        return lambda pages: fixed_chunks(pages, **options)
    if strategy == "sentence":
        return lambda pages: sentence_chunks(pages, **options)
    if strategy == "semantic":
        if encoder is None:
            raise ValueError("the semantic strategy needs an encoder")
        return lambda pages: semantic_chunks(pages, encoder, **options)
    raise ValueError(f"unknown strategy {strategy!r}; there are fixed, sentence and semantic")
