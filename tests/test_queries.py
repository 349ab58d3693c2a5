"""Every registered query of the engine's own operators against its SQL, and streaming against batch."""

from __future__ import annotations

import math

import duckdb
import pytest

from velith.operators.chunking import as_pages, sentence_chunks
from velith.plans import catalog, flagship

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    return con


def plain(x):
    return round(x, 6) if isinstance(x, float) and not math.isnan(x) else x


QUERIES = {"flagship": flagship.hybrid_answers, **catalog.queries()}
SQL = {"flagship": flagship.SQL, **catalog.oracle_sql()}


def test_every_query_has_sql_or_a_test_of_its_own():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == set()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    expected = sorted(repr(tuple(map(plain, r))) for r in found.fetchall())
    assert sorted(repr(tuple(map(plain, r))) for r in df.select(*names).collect()) == expected


def test_stream_equals_batch(spark):
    stream = catalog.queries()["op_stream_ingest"](spark, FOLDER)
    batch = sentence_chunks(as_pages(spark.read.parquet(f"{FOLDER}/documents.parquet")))
    assert sorted(r["chunk_id"] for r in stream.collect()) == sorted(r["chunk_id"] for r in batch.collect())


def test_ask_covers_every_question(spark):
    rows = catalog.queries()["op_ask"](spark, FOLDER).collect()
    assert len(rows) == spark.read.parquet(f"{FOLDER}/benchmark.parquet").count()
    assert all(r["refused"] or r["n_sources"] > 0 for r in rows)
