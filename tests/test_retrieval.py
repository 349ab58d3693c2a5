"""Search and fusion against plain Python."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from velith.functions import answers, lexicon
from velith.operators import bm25, dense, fusion
from velith.plans import retrieval

DOCS = [(1, "rest rest period night work"), (2, "night work rules apply"), (3, "leave and pay"), (4, None), (5, "night work rules apply"), (6, "night shift night shift night")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("term", F.lit(0))


def okapi(query: list[str]) -> dict[int, float]:
    bags = {d: [w for w in (t or "").split() if w not in lexicon.STOPWORDS] for d, t in DOCS}
    n, mean = len(bags), sum(map(len, bags.values())) / len(bags)
    df = Counter(w for b in bags.values() for w in set(b))
    idf = {w: math.log(n - x + 0.5) - math.log(x + 0.5) for w, x in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: floor if x < 0 else x for w, x in idf.items()}
    return {d: sum(idf.get(w, 0) * b.count(w) * 2.5 / (b.count(w) + 1.5 * (0.25 + 0.75 * len(b) / mean)) for w in query) for d, b in bags.items()}


def test_bm25_equals_the_formula(spark, docs, tmp_path):
    index = bm25.build(docs)
    asked = spark.createDataFrame([(1, "night night work?"), (2, "the of"), (3, "leave pay rest"), (4, None)], "q int, text string")
    index.write(str(tmp_path / "index"))
    for found in (index, bm25.Index.read(spark, str(tmp_path / "index"))):
        hits = {}
        for r in bm25.search(found, asked, 3, ["q"]).orderBy("q", "rank").collect():
            hits.setdefault(r["q"], []).append((r["id"], r["score"]))
        assert set(hits) == {1, 3}
        for q, words in ((1, ["night", "night", "work"]), (3, ["leave", "pay", "rest"])):
            every = sorted(((d, round(s, 6)) for d, s in okapi(words).items() if s > 1e-9), key=lambda x: (-x[1], x[0]))[:3]
            assert [d for d, _ in hits[q]] == [d for d, _ in every]
            assert [s for _, s in hits[q]] == pytest.approx([s for _, s in every], abs=2e-6)


def test_bm25_without_texts(spark):
    with pytest.raises(ValueError):
        bm25.build(spark.createDataFrame([], "doc_id long, text string"))


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclid"])
def test_dense_equals_brute_force(spark, metric, monkeypatch):
    monkeypatch.setattr(dense, "QUERY_BLOCK", 3)
    monkeypatch.setattr(dense, "ROW_BLOCK", 7)
    rng = np.random.default_rng(3)
    rows = [(int(k), [float(x) for x in rng.integers(-2, 3, 4)]) for k in range(60)] + [(60, None), (61, [1.0]), (62, [0.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    asked = df.filter("vec_id % 7 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = {}
    for r in dense.top_k(df, asked, 5, metric).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["id"], r["score"]))

    def score(a, b):
        a, b = np.array(a), np.array(b)
        if metric == "dot":
            return float(a @ b)
        if metric == "euclid":
            return -float(np.sqrt(((a - b) ** 2).sum()))
        size = np.linalg.norm(a) * np.linalg.norm(b)
        return float(a @ b / size) if size else 0.0

    for q, v in rows:
        if v is None or q % 7:
            continue
        every = sorted(((i, round(score(v, w), 6) + 0.0) for i, w in rows if w is not None and len(w) == len(v)), key=lambda x: (-x[1], x[0]))[:5]
        assert [i for i, _ in found[q]] == [i for i, _ in every]
        assert [s for _, s in found[q]] == pytest.approx([s for _, s in every], abs=2e-6)


def test_dense_rejects_unknown_metric():
    with pytest.raises(ValueError):
        dense.scores(np.zeros((1, 2)), np.zeros((1, 2)), "other")


def hits(spark, rows):
    return spark.createDataFrame(rows, "q int, id int, rank int, score double")


def test_rrf_and_merge(spark):
    d = hits(spark, [(1, 10, 1, 0.9), (1, 11, 2, 0.8)])
    s = hits(spark, [(1, 11, 1, 7.0), (1, 12, 2, 5.0), (2, 9, 1, 1.0)])
    got = [tuple(r) for r in fusion.rrf([d, s], "q").orderBy("q", "rank").collect()]
    assert [(q, i) for q, _, i, _ in got] == [(1, 11), (1, 10), (1, 12), (2, 9)]
    assert got[0][3] == pytest.approx(1 / 62 + 1 / 61, abs=1e-9)
    with pytest.raises(ValueError):
        fusion.rrf([d, s], "q", weights=[1.0])
    heavy = fusion.rrf([d, s], "q", weights=[3.0, 1.0]).filter("q = 1 and rank = 1").first()
    assert heavy["id"] == 11
    merged = {r["id"]: r for r in fusion.merge_results(d, s, "q").filter("q = 1").collect()}
    assert {k: r["retriever"] for k, r in merged.items()} == {10: "dense", 11: "hybrid", 12: "sparse"}
    assert (merged[11]["dense_rank"], merged[11]["sparse_rank"], merged[12]["dense_score"]) == (2, 1, None)


def test_variants_keep_the_first_score(spark):
    rows = [(1, 0, 1, 10, 3.0), (1, 0, 2, 11, 2.0), (1, 1, 1, 11, 9.0), (1, 1, 2, 12, 2.0)]
    df = spark.createDataFrame(rows, "q int, variant int, rank int, id int, score double")
    assert [(r["id"], r["score"]) for r in fusion.merge_variants(df, "q", 3).orderBy("rank").collect()] == [(10, 3.0), (11, 2.0), (12, 2.0)]


@pytest.mark.parametrize(
    ("mode", "dense_score", "sparse_score", "both", "n", "expected"),
    [("hybrid", 0.95, 3.0, 5, 5, 1.0), ("hybrid", 0.70, 3.0, 0, 5, 0.0), ("dense", 1.4, None, 0, 2, 1.0), ("sparse", None, 12.0, 0, 2, 0.5), ("sparse", None, None, 0, 1, 0.0), ("dense", None, None, 0, 0, 0.0), ("hybrid", None, 12.0, 1, 2, 0.5)],
)
def test_confidence(spark, mode, dense_score, sparse_score, both, n, expected):
    df = spark.createDataFrame([(mode, dense_score, sparse_score, both, n)], "m string, d double, s double, b long, n long")
    assert df.select(answers.confidence("m", "d", "s", "b", "n")).first()[0] == expected


def test_questions_without_hits_are_refused(spark, docs):
    asked = spark.createDataFrame([(1, "night work"), (2, "nothing like it")], "q int, text string")
    results = retrieval.retrieve("sparse", "q", sparse_list=retrieval.sparse_hits(bm25.build(docs), asked, "q"))
    sure = {r["q"]: (r["results"], r["confidence"]) for r in fusion.with_confidence(asked, results, "q", "sparse").collect()}
    assert sure[2] == (0, 0.0) and sure[1][0] > 0
    with pytest.raises(ValueError):
        retrieval.retrieve("other", "q")


def test_bm25_steps_are_dealt_by_their_own_size(spark, docs, monkeypatch):
    """More text makes more tasks, not larger ones, whatever the number of shuffle partitions is."""
    monkeypatch.setattr(bm25, "TASK_TEXT", 2)
    for made in (bm25.postings(docs), bm25.term_frequencies(docs)):
        assert made.rdd.getNumPartitions() > 30
    assert {r["term"]: r["df"] for r in bm25.term_frequencies(docs).collect()} == Counter(w for _, t in DOCS for w in {*(t or "").split()} - {*lexicon.STOPWORDS})


@pytest.mark.parametrize("small", [True, False])
def test_bm25_within_ids_that_are_too_many_to_broadcast(spark, docs, monkeypatch, small):
    if not small:
        monkeypatch.setattr(bm25, "bounded", lambda df: df)
    asked = spark.createDataFrame([(1, "night work")], "q int, text string")
    within = spark.createDataFrame([(2,), (6,), (6,), (77,)], "id long")
    index = bm25.build(docs)
    every = {r["id"]: r["score"] for r in bm25.search(index, asked, 9, ["q"]).collect()}
    assert {r["id"]: r["score"] for r in bm25.search(index, asked, 9, ["q"], within=within).collect()} == {k: every[k] for k in (2, 6)}
