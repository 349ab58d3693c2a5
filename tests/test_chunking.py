"""The chunkers against loops, and their invariants on odd input."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from velith.operators import chunking as c

PAGES = "doc_id string, page_number int, section string, text string"


def pack(counts: list[int], budget: int, overlap: int) -> list[tuple[int, int]]:
    out, start, total = [], 0, 0
    for i, n in enumerate(counts):
        if n > budget:
            if start < i:
                out.append((start, i))
            out.append((i, i + 1))
            start, total = i + 1, 0
        elif total + n > budget and start < i:
            out.append((start, i))
            start = max(start, i - overlap)
            total = sum(counts[start:i]) + n
        else:
            total += n
    return [*out, (start, len(counts))] if start < len(counts) else out


def cut(counts: list[int], distances: list[float | None], budget: int, least: int, threshold: float) -> list[tuple[int, int]]:
    if len(counts) <= least:
        return [(0, len(counts))]
    out, start, total = [], 0, counts[0]
    for i in range(1, len(counts)):
        if (distances[i] >= threshold and i - start >= least) or total + counts[i] > budget:
            out.append((start, i))
            start, total = i, counts[i]
        else:
            total += counts[i]
    return [*out, (start, len(counts))]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(0, 30), max_size=20), min_size=1, max_size=8), st.integers(1, 40), st.integers(0, 3))
def test_sentence_ranges_equal_the_loop(spark, many, budget, overlap):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(many)], "k int, counts array<int>")
    found = {r["k"]: [tuple(x) for x in r["r"]] for r in df.select("k", c.sentence_ranges(F.col("counts"), budget, overlap).alias("r")).collect()}
    assert found == {k: pack(x, budget, overlap) for k, x in enumerate(many)}


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.integers(1, 30), st.sampled_from([0.0, 0.1, 0.5])), min_size=1, max_size=20), min_size=1, max_size=8), st.integers(1, 60), st.integers(1, 4))
def test_semantic_ranges_equal_the_loop(spark, many, budget, least):
    rows = [(k, [(i, n, d if i else None) for i, (n, d) in enumerate(x)], float(np.quantile([d for _, d in x], 0.85))) for k, x in enumerate(many)]
    df = spark.createDataFrame(rows, "k int, items array<struct<i:int,n:int,d:double>>, t double")
    found = {r["k"]: [tuple(x) for x in r["r"]] for r in df.select("k", c.semantic_ranges(F.col("items"), budget, least, F.col("t")).alias("r")).collect()}
    assert found == {k: cut([n for _, n, _ in x], [d for _, _, d in x], budget, least, t) for k, x, t in rows}


@pytest.fixture(scope="module")
def pages(spark):
    long = "This is one sentence of eight words here. "
    data = [
        ("a", 1, "§ 1 Scope", "§ 1 Scope\nFirst rule here. " + long * 3),
        ("a", 2, None, "It goes on. § 2 Leave\nSecond rule. " + long * 3),
        ("b", 1, None, "word " * 80 + "."),
        ("c", 1, None, ""),
        ("d", 1, None, None),
        ("e", 1, None, "same. Same. " * 5),
        ("e", 1, None, "same. Same. " * 5),
    ]
    return spark.createDataFrame(data, PAGES)


def test_fixed_windows(spark, pages):
    found = {}
    for r in c.fixed_chunks(pages, 10, 3).orderBy("doc_id", "chunk_index").collect():
        found.setdefault(r["doc_id"], []).append(r)
    assert set(found) == {"a", "b", "e"}
    for doc, rows in found.items():
        texts = [" ".join(t.split()) for d, _, _, t in (tuple(p) for p in sorted(pages.collect(), key=repr)) if d == doc]
        words = " ".join(texts).split()
        expected = [words[s : s + 10] for s in range(0, len(words), 7) if s == 0 or s + 3 < len(words)]
        assert [r["text"].split() for r in rows] == expected
        assert [r["chunk_index"] for r in rows] == list(range(len(rows)))
        assert all(r["token_count"] == len(r["text"].split()) <= 10 for r in rows)
    first = found["a"]
    assert (first[0]["page_start"], first[0]["section"], first[-1]["page_end"]) == (1, "§ 1 Scope", 2)


def test_fixed_rejects_bad_sizes(pages):
    for size, overlap in ((0, 0), (10, 10), (10, -1)):
        with pytest.raises(ValueError):
            c.fixed_chunks(pages, size, overlap)


def test_sections_follow_headings_inside_pages(pages):
    got = [(r["page"], r["section"]) for r in c.pages_to_sentences(pages).filter("doc_id = 'a'").orderBy("ix").collect()]
    assert got[0] == (1, "§ 1 Scope")
    assert (2, "§ 1 Scope") in got and got[-1] == (2, "§ 2 Leave")


def test_sentence_chunks_keep_budget_and_pages(pages):
    rows = c.sentence_chunks(pages, 20, 1).collect()
    assert {r["doc_id"] for r in rows} == {"a", "b", "e"}
    assert len({r["chunk_id"] for r in rows}) == len(rows)
    assert [r["token_count"] for r in rows if r["doc_id"] == "b"] == [81]
    assert all(1 <= r["page_start"] <= r["page_end"] <= 2 for r in rows)


def test_semantic_needs_an_encoder_and_splits(pages):
    with pytest.raises(ValueError):
        c.chunker("semantic")
    with pytest.raises(ValueError):
        c.chunker("other")
    rows = c.chunker("semantic", c.letter_encoder, budget=40)(pages).collect()
    assert {r["doc_id"] for r in rows} == {"a", "b", "e"}


def test_topic_shift(spark):
    text = "Leave is paid. Leave is long. Leave is due. Pay is monthly. Pay is high. Pay is fair."
    one_hot = lambda t: F.array(F.contains(t, F.lit("Leave")).cast("double"), F.contains(t, F.lit("Pay")).cast("double"))
    df = spark.createDataFrame([("x", 1, None, text)], PAGES)
    assert [r["text"] for r in c.semantic_chunks(df, one_hot).orderBy("chunk_index").collect()] == [text[:43].strip(), text[43:].strip()]


def test_empty_table(spark):
    none = spark.createDataFrame([], PAGES)
    for name in ("fixed", "sentence"):
        assert c.chunker(name)(none).count() == 0
    assert c.semantic_chunks(none, c.letter_encoder).count() == 0


def test_extra_columns_do_not_clash(pages):
    odd = pages.withColumn("n", F.lit(1)).withColumn("chunk_index", F.lit("x")).withColumn("s", F.lit(2)).withColumn("w", F.lit(3))
    assert c.sentence_chunks(odd, 20).count() == c.sentence_chunks(pages, 20).count()
    assert c.fixed_chunks(odd, 20, 2).count() == c.fixed_chunks(pages, 20, 2).count()


def test_budget_in_tokens_of_a_tokenizer_file(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from velith.sources.models import token_counter

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    size = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    docs = spark.createDataFrame([(1, " ".join(f"Unbelievably long-winded sentence number {k} stands here." for k in range(30))), (2, None)], "doc_id int, text string")
    found = c.sentence_chunks(c.as_pages(docs), 40, 0, token_counter(path)).collect()
    assert len(found) > 5 and all(r["token_count"] == size(r["text"]) for r in found)
    assert all(sum(size(s) for s in r["text"].split(". ")) <= 44 for r in found)


def test_letters_are_counted_in_batches_as_the_patterns_do(spark):
    """No list of matches is built for a text, whose every letter would be one; the counts are those of the patterns."""
    import re

    texts = ["Aé bcd 1, zz ÄÖ  Q9", "", None, "　ß🙂x", "aeiou" * 300, "B C"]
    groups = ["[aeiou]", "[bcdfg]", "[hjklm]", "[npqrs]", "[tvwxyz]", "[0-9]", "[ ]", "[A-Z]"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").repartition(2)
    found = df.select("k", "text", c.letter_encoder(F.col("text")).alias("v"))
    assert "regexp_extract_all" not in found._jdf.queryExecution().executedPlan().toString()
    expected = {k: [None if t is None else float(len(re.findall(g, t))) for g in groups] for k, t in enumerate(texts)}
    assert {r["k"]: r["v"] for r in found.collect()} == expected


def test_semantic_chunks_sort_sentences_once(spark, pages):
    """One sort of the pages and one of the sentences: distances take the order that numbers and sections have."""
    plan = c.semantic_chunks(pages, c.letter_encoder, 40)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 2
