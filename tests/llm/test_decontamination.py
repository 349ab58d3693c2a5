"""Contamination by benchmark windows against a plain scan."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from velith.llm import decontamination as dc


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items, window=10):
    own, hit, found = words(text), set(), set()
    for item, body in items:
        w = words(body)
        if item is None or not w:
            continue
        n = min(window, len(w))
        wanted = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        for k in range(len(own) - n + 1):
            if tuple(own[k : k + n]) in wanted:
                hit.update(range(k, k + n))
                found.add(str(item))
    return len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.fixture(scope="module")
def case():
    rng = np.random.default_rng(4)
    vocabulary = ["Ape", "bee", "CAT", "dog", "élan", "ÉLAN", "fox", "a1", "2b", "ant"]
    pick = lambda n: [vocabulary[k] for k in rng.integers(0, len(vocabulary), n)]
    items = [(k, " ".join(pick(int(n)))) for k, n in enumerate([30, 12, 10, 9, 4, 25, 11, 3])] + [(7, "x y z"), (20, "one, TWO;three"), (21, None), (22, "..."), (None, "never named item"), (100, "solo"), (3, " ".join(pick(15)))]
    docs = [(k, " ".join(pick(int(n)))) for k, n in enumerate(rng.integers(0, 60, 30))]
    for k, (_, body) in enumerate(items):
        w = words(body)
        docs.append((100 + k, " ".join(pick(5) + w[:12] + pick(4))))
        docs.append((200 + k, "-".join(w) + "!"))
        docs.append((300 + k, " ".join(w[:-1] + ["zzz"])))
    docs += [(900, None), (901, ""), (902, "..,,"), (903, "one two three one two"), (903, "again"), (None, "solo"), (904, "word " * 40000 + "x y z"), (905, "solo solo solo")]
    return items, docs


@pytest.mark.parametrize("block_bytes", [1 << 20, 90])
def test_equals_a_plain_scan(spark, documents, case, block_bytes):
    items, docs = case
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit("clash"))
    found = dc.contamination(documents(docs), bench, block_bytes=block_bytes).collect()
    got = sorted(repr((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"])) for r in found)
    assert got == sorted(repr((i, *brute(t, items))) for i, t in docs)


@pytest.mark.parametrize("block_bytes", [1 << 20, 90])
def test_decontaminate_drops_what_is_hit(spark, documents, case, block_bytes):
    items, docs = case
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = dc.decontaminate(documents(docs), bench, block_bytes=block_bytes)
    assert out.columns == documents(docs).columns
    assert sorted(repr(r["doc_id"]) for r in out.collect()) == sorted(repr(i) for i, t in docs if not brute(t, items)[4])


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r["n_hit"] for r in dc.contamination(documents([(1, "a b")]), none).collect()] == [0]
    assert dc.contamination(documents([]), none).count() == 0
    assert dc.decontaminate(documents([(1, "a b")]), none).count() == 1
