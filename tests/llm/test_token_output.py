"""Shards against the tokenizers library, and the file format by itself."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from velith.llm import token_output as to
from velith.llm.common import scratch_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["Hello world, it's 2024!", None, "", "  blanks\n\n\ttabs \x1c x\x85y\xa0z", "café “quotes” — 😀 你好", "<|endoftext|> inside", "don't we'll I'VE", "a" * 5000, "word and " * 30_000, "ǅ ß ² ½ ⅷ", "\x00\x7f", "tail  ", "é ​"]


@pytest.mark.parametrize("options", [{}, {"plane": "bit", "block_ids": 64}, {"block_ids": 1000, "shard_ids": 3000}])
def test_table_equals_the_library(documents, options):
    library = Tokenizer.from_file(PATH)
    rows = [(7 * k % 40, t) for k, t in enumerate(TEXTS)]
    at, expected = 0, []
    for i, t in sorted(rows):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        expected.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = sorted(map(tuple, to.token_table(documents(rows), PATH, 2, **options).collect()))
    assert got == expected


def test_repeated_and_null_ids(documents):
    got = sorted(map(tuple, to.token_table(documents([(1, "a b"), (1, "a b"), (1, None), (None, "x")]), PATH, 2).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, 1, 1, 1] and [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1].tolist()]


def test_ids_come_back(spark, documents):
    folder = scratch_path(spark, "shards")
    manifest = to.write_shards(documents([(2, "b c"), (1, "a")]), PATH, 2, folder)
    library = Tokenizer.from_file(PATH)
    assert {r["doc_id"]: r["ids"] for r in to.read_ids(manifest).collect()} == {1: [*library.encode("a").ids, 2], 2: [*library.encode("b c").ids, 2]}


def test_empty_table(documents):
    assert to.token_table(documents([]), PATH, 2).count() == 0


@pytest.mark.parametrize("plane", ["byte", "bit"])
def test_planes_round_trip(plane):
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 8, 9, 1000):
        ids = rng.integers(0, 2**32, n, dtype=np.uint64).astype("<u4")
        assert (to.join_planes(to.split_planes(ids, plane), n, plane) == ids).all()


def test_whole_table_at_small_scale(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    library = Tokenizer.from_file(PATH)
    at, expected = 0, []
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        expected.append((r["doc_id"], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, to.token_table(docs, PATH, 2).collect())) == expected
