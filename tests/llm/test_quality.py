"""The positive-unlabelled classifier: the risk it minimises, and what it learns."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from velith.llm import quality


def texts(rng, good, n):
    words = [f"w{k}" for k in range(300)]
    out = []
    for _ in range(n):
        own = list(rng.choice(words, int(rng.integers(20, 120))))
        if not good:
            own = [w.upper() + "!!!" if rng.random() < 0.5 else w for w in own for _ in range(2)]
        out.append(" ".join(own))
    return out


@pytest.fixture(scope="module")
def tables(spark, documents):
    rng = np.random.default_rng(2)
    rows = [*((k, t) for k, t in enumerate(texts(rng, True, 200))), *((200 + k, t) for k, t in enumerate(texts(rng, False, 120)))]
    odd = [(900, None), (901, ""), (902, "x" * 500_000), (903, "!!"), (900, None), (None, "null id")]
    labels = [(k, 1 if k < 200 else 0, 0) for k in range(0, 320, 2)] + [(None, 1, 0), (900, None, 0), (901, 7, None), (4, 1, 1)]
    return documents(rows + odd), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("id", F.lit("clash")).withColumn("y", F.lit(5)), rows


def test_learns_from_training_rows_only(tables):
    docs, labels, rows = tables
    model = quality.train(docs, labels)
    found = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items() if i is not None)
    held = [(found[k]["score"], k < 200) for k, _ in rows if found[k]["held_out"]]
    assert np.mean([(s >= 0.3) == y for s, y in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found.values())
    unlearned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in quality.score(docs, quality.train(docs, unlearned)).collect()}
    assert again == {i: r["score"] for i, r in found.items()}


def test_scores_need_the_text_alone(tables):
    docs, labels, _ = tables
    model = quality.train(docs, labels)
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("y")).withColumn("doc_id", F.col("doc_id") + 5000)
    assert sorted(r["score"] for r in quality.score(other, model).collect()) == sorted(r["score"] for r in quality.score(docs, model).collect())


def test_keep_good_keeps_columns(tables):
    docs, labels, _ = tables
    model = quality.train(docs, labels)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert sorted(repr(r["doc_id"]) for r in kept.collect()) == sorted(repr(r["doc_id"]) for r in quality.score(docs, model).filter("predicted = 1").collect())


def test_without_labels_the_score_is_the_prior(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = documents([(1, "a"), (2, None)])
    model = quality.train(docs, none)
    assert [round(r["score"], 6) for r in quality.score(docs, model).collect()] == [0.5, 0.5]
    assert quality.score(documents([]), quality.train(documents([]), none)).count() == 0


def test_the_risk_is_unbiased_and_bounded():
    """On separable data whose unlabelled part holds the prior's share of positives, most of it is found again."""
    rng = np.random.default_rng(0)
    width = quality.WIDTH
    make = lambda n, shift: np.c_[rng.normal(shift, 1, (n, 4)), np.zeros((n, width - 4))]
    positive, unlabelled = make(300, 1.5), np.concatenate([make(400, 1.5), make(600, -1.5)])
    truth = np.r_[np.ones(400), np.zeros(600)]
    rows = lambda x: (x, np.arange(len(x)) % 5)
    model = quality.fit(rows(positive), rows(unlabelled), rows(unlabelled[:0]), truth[:0], 0.4)
    assert np.mean((model.margin(unlabelled) > 0) == truth) > 0.95


def test_isotonic_rises():
    at, value = quality.isotonic(np.array([0.0, 1, 2, 3, 4, 4]), np.array([0, 1, 0, 1, 1, 0.0]))
    assert (np.diff(value) >= 0).all() and (np.diff(at) >= 0).all()


@pytest.mark.parametrize("prior", [0.15, 0.4, 0.8])
def test_prior_is_found_from_positives_and_unlabelled_rows(prior):
    rng = np.random.default_rng(8)
    part = lambda n, shift: rng.standard_normal((n, quality.WIDTH)) + shift
    n = 3000
    unlabelled = np.concatenate([part(int(n * prior), 0.25), part(n - int(n * prior), -0.25)])
    fold = lambda x: rng.integers(0, quality.FOLDS, len(x))
    positive = part(1500, 0.25)
    assert abs(quality.class_prior((positive, fold(positive)), (unlabelled, fold(unlabelled))) - prior) < 0.1


def test_held_out_accuracy_on_the_shared_table(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    found = quality.score(docs, quality.train(docs, labels)).join(labels, "doc_id").filter("held_out").select("quality", "predicted").collect()
    assert len(found) > 50 and sum(r["quality"] == r["predicted"] for r in found) >= 0.9 * len(found)


def test_features_of_a_long_text_of_marks_take_linear_time():
    import time

    began = time.perf_counter()
    quality.features([" ".join(chr(33 + k % 15) + chr(33 + k // 15 % 15) + chr(33 + k // 225 % 15) for k in range(400_000))])
    assert time.perf_counter() - began < 20
