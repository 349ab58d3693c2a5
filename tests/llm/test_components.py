from __future__ import annotations

import numpy as np
import pytest

from tests.llm.conftest import groups
from velith.llm import components as cc
from velith.llm.components import components, local_roots


@pytest.mark.parametrize(("seed", "most"), [(0, 10**6), (1, 10**6), (2, 10**6), (0, 0), (1, 20)])
def test_random_graphs(spark, seed, most, monkeypatch):
    monkeypatch.setattr(cc, "BROADCAST_LINKS", most)
    rng = np.random.default_rng(seed)
    links = [tuple(map(int, x)) for x in rng.integers(0, 60, (40, 2))] + [(100 + k, 101 + k) for k in range(30)] + [(200, 201 + k) for k in range(30)]
    found = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert found == groups([(a, b) for a, b in links if a != b], nodes)


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).count() == 0


def test_local_roots():
    ids = np.array([9, 4, 7, 1, 30])
    assert local_roots(ids, np.array([0, 1]), np.array([1, 2])).tolist() == [4, 4, 4, 1, 30]
