from __future__ import annotations

import pytest
from pyspark.sql import functions as F

#: Columns that the operators use inside under these names.
CLASHING = ["id", "n", "set", "rep", "component", "node", "a", "b", "u", "v", "hi", "lo", "bands", "value", "size", "k", "line", "name", "runs", "score", "label_", "payload", "digest", "kept", "held_out", "uri", "start", "blocks", "mask", "items"]


@pytest.fixture(scope="session")
def documents(spark):
    """Rows of (doc_id, text) as a documents table with extra columns of clashing names."""

    def make(rows):
        df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        for name in CLASHING:
            df = df.withColumn(name, F.lit("clash"))
        return df

    return make


def groups(links, nodes):
    """node -> least node reachable."""
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}
