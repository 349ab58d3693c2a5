"""The random-projection forest against all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import groups
from velith.llm import embedding_dedup as ed

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=0.93):
    ok = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        ok.append((i, np.array(v, np.float32).astype(np.float64), label))
    links = [(a, b) for k, (a, x, p) in enumerate(ok) for b, y, q in ok[k + 1 :] if p == q and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= cosine]
    return links


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(6)
    out, i = [], 0
    for label in range(3):
        for _ in range(25):
            base = rng.standard_normal(16)
            for _ in range(int(rng.integers(1, 7))):
                out.append((i, (base + rng.standard_normal(16) * rng.choice([0.0, 0.1, 0.2, 0.3])).astype(np.float32).tolist(), label))
                i += 1
    base = rng.standard_normal(16)
    for _ in range(150):
        out.append((i, (base + rng.standard_normal(16) * 0.12).astype(np.float32).tolist(), 1))
        i += 1
    odd = [None, [0.0] * 16, [None] + [1.0] * 15, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [], [1.0], [2.0], out[0][1], out[0][1]]
    out += [(1000 + k, v, 0) for k, v in enumerate(odd)]
    return [*out, (2000, out[0][1], None), (None, out[0][1], 0), (3000, [-0.0] * 15 + [1.0], 2), (3001, [0.0] * 15 + [1.0], 2)]


def check(found, rows, least_recall):
    links = brute(rows)
    got = {r["vec_id"]: r for r in found if r["vec_id"] is not None}
    assert len(found) == len(rows)
    count = dict.fromkeys(got, 0)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    assert all(r["n_links"] <= count[i] for i, r in got.items())
    total = sum(count.values())
    recall = sum(r["n_links"] for r in got.values()) / total if total else 1
    assert recall >= least_recall
    if recall == 1:
        assert {i: r["component_id"] for i, r in got.items()} == groups(links, set(got))
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_forest_equals_all_pairs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("rep", F.lit("clash")).withColumn("code", F.lit(1)).withColumn("weight", F.lit(7))
    check(ed.near_duplicates(df).collect(), rows, 1.0)


def test_routing_keeps_nearly_all(spark, rows):
    found = ed.near_duplicates(spark.createDataFrame(rows, SCHEMA), group=60, node_sample=200, leaf=8).collect()
    check(found, rows, 0.9)


def test_a_cluster_that_cannot_be_split_meets_in_blocks(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal(16)
    rows = [(k, (base + rng.standard_normal(16) * 0.01).astype(np.float32).tolist(), 1) for k in range(100)]
    check(ed.near_duplicates(spark.createDataFrame(rows, SCHEMA), group=30).collect(), rows, 1.0)


def test_groups_stay_bounded_however_many_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.standard_normal(32).astype(np.float32).tolist(), 1, 1, 32) for k in range(6000)]
    classes = spark.createDataFrame([(label, dim, k, w, v) for k, v, label, w, dim in rows], "label long, dim long, rep long, weight long, embedding array<float>")
    placed = ed.route(classes, 0.93, 500, 2, 500)
    sizes = placed.groupBy("label", "dim", "code").count().agg(F.max("count"), F.count("*"), F.sum("count")).first()
    assert sizes[0] <= 500 and sizes[1] >= 24
    assert sizes[2] <= 6000 * 2 * 3  # copies by two routes and their margins
    assert placed.select("rep").distinct().count() == 6000


def leaf_sizes(data, **options):
    by = {}
    for i, v, label in data:
        by.setdefault(label, []).append(v)
    for label in sorted(by, key=str):
        x = np.array(by[label], np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        yield len(x), [len(o) for o in ed.leaves(x.astype(np.float32), ed.LEAF, ed.margin(0.93, x.shape[1], ed.SPILL), np.random.default_rng(0))]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "check_s"])
def test_trees_are_grown_on_the_shared_tables(spark, sf):
    """Every label's rows are split into leaves with the production parameters, and none of them is the whole label."""
    path = f"/root/testdata/{sf}/embeddings.parquet"
    data = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(path).filter("label is not null and embedding is not null").collect()]
    for n, leaves in leaf_sizes(data):
        assert len(leaves) > 1 and max(leaves) < n
    if sf == "sf0.01":
        check(ed.near_duplicates(spark.read.parquet(path)).collect(), data, 0.95)


def test_empty_table(spark):
    assert ed.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    only = spark.createDataFrame([(1, None, None)], SCHEMA)
    assert [tuple(r) for r in ed.near_duplicates(only).collect()] == [(1, 0, 1, True)]


def test_scaled_copies_and_mixed_lengths(spark):
    rows = [(1, [1.0, 2.0], 1), (2, [2.0, 4.0], 1), (3, [1.0, 2.0, 0.0], 1), (4, [3.0e30, 6.0e30], 1), (5, [1.0, 2.0], 2)]
    check(ed.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect(), rows, 1.0)
