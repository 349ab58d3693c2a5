"""The pipeline stage by stage against brute force on its own input, and the queries against their SQL."""

from __future__ import annotations

import duckdb
import public_tokenizers
import pytest
import sentencepiece

import __spark_entry__ as entry
import corpus_pipeline as cp
from tests.llm.test_decontamination import brute as contaminated
from tests.llm.test_line_dedup import brute as repeated
from tests.llm.test_near_dedup import brute as near
from velith.llm import queries as llm
from velith.llm.common import materialise

FOLDER = "/root/testdata/sf0.001"


def test_ten_operators_and_the_pipeline_are_registered():
    names = list(entry.queries())
    assert [n for k in range(1, 11) for n in names if n.startswith(f"op{k}_")] == sorted(llm.queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert len(llm.queries()) == 10 and "pipeline" in names and set(entry.oracle_sql()) <= set(names)


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in cp.STAGES[:-1]:
        before = docs
        docs = materialise(stage(spark, docs, FOLDER), name)
        assert docs.columns == columns and docs.schema == before.schema
        seen[name] = (before.collect(), docs.collect())
    last = cp.STAGES[-1][1](spark, docs, FOLDER).collect()

    before, after = seen["quality"]
    good = {r["doc_id"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").filter("quality = 1").collect()}
    kept = {r["doc_id"] for r in after}
    assert kept <= {r["doc_id"] for r in before} and len(good - kept) <= 0.02 * len(good) + 1

    before, after = seen["line_dedup"]
    gone = repeated([(r["doc_id"], r["text"]) for r in before if len(r["text"] or "") < 20_000], 50)
    out = {r["doc_id"]: r["text"] for r in after}
    for r in before:
        cut = gone.get((True, r["doc_id"], r["text"]))
        if cut:
            left = "\n".join(x for k, x in enumerate(r["text"].split("\n")) if k not in cut)
            assert out.get(r["doc_id"], "") == left
        elif cut is not None and r["text"].strip():
            assert out[r["doc_id"]] == r["text"]

    before, after = seen["near_dedup"]
    roots = near([(r["doc_id"], r["text"]) for r in before], 5)
    assert sorted(r["doc_id"] for r in after) == sorted(i for i, root in roots.items() if i == root)

    before, after = seen["decontaminate"]
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before if not contaminated(r["text"], items)[4])

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert {r["doc_id"]: r["n_tokens"] for r in last} == {r["doc_id"]: len(library.encode(r["text"] or "")) + 2 for r in after}
    assert sorted(map(repr, cp.run(spark, FOLDER).collect())) == sorted(map(repr, last))


def test_quality_stage_drops_bad_documents_and_keeps_good_ones(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in cp.stage_quality(spark, docs, folder).select("doc_id").collect()}
    good, bad = ({i for i, y in labels.items() if y == wanted} for wanted in (1, 0))
    assert len(bad) > 20 and len(bad & kept) <= 0.1 * len(bad) and len(good - kept) <= 0.02 * len(good)


@pytest.mark.parametrize("name", [name for name, _ in cp.STAGES])
def test_stage_on_odd_rows_and_on_none(spark, documents, name):
    """Null and empty texts, null and repeated ids, ties and one long text, with columns of clashing names."""
    stage = dict(cp.STAGES)[name]
    long = "\n".join(f"line {k} of a text that goes on and on" for k in range(4000))
    docs = documents([(1, None), (2, ""), (3, " \n "), (None, "no id here"), (4, "the same words twice over"), (4, "the same words twice over"), (5, long), (6, "the same words twice over")])
    out = stage(spark, docs, FOLDER)
    rows = out.collect()
    if name == "encode":
        assert len(rows) == 8 and {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2)} == {2} and all(r["aligned"] for r in rows)
    else:
        assert out.columns == docs.columns
        ids = [r["doc_id"] for r in rows]
        if name != "quality":
            assert {1, 2, 3, None, 4, 5} <= set(ids) and ids.count(4) == 2
            assert (6 in ids) == (name != "near_dedup")
            assert next(r["text"] for r in rows if r["doc_id"] == 5) == long
    assert stage(spark, documents([]), FOLDER).count() == 0


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    df = llm.queries()[name](spark, FOLDER)
    found = con.execute(llm.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(repr, found.fetchall()))
