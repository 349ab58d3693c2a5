"""Keyed changes, snapshots, statistics, ingestion, configuration."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from velith.operators import evaluation, statistics, store
from velith.operators.sizes import bounded
from velith.plans.ingestion import KnowledgeBase, embed, ingest
from velith.sources import config, corpora, files
from velith.sources.models import encoder
from velith.sources.snapshots import SnapshotTable


def frame(spark, rows, schema="k int, v string, t int"):
    return spark.createDataFrame(rows, schema)


def test_upsert_keeps_and_replaces(spark, rows):
    old = frame(spark, [(1, "a", 1), (2, "b", 1), (None, "n", 1)])
    new = frame(spark, [(2, "B", 2), (3, "C", 2)])
    assert rows(store.upsert(old, new, ["k"], keep=("t",))) == sorted([(1, "a", 1), (2, "B", 1), (None, "n", 1), (3, "C", 2)], key=repr)
    assert rows(store.upsert(old, frame(spark, []), ["k"])) == rows(old)
    assert rows(store.upsert(frame(spark, []), new, ["k"])) == rows(new)


def test_replace_delete_mark_prune(spark, rows):
    old = frame(spark, [(1, "a", 1), (1, "a", 2), (2, "b", 1)])
    assert rows(store.replace_groups(old, frame(spark, [(1, "z", 9)]), ["k"])) == [(1, "z", 9), (2, "b", 1)]
    gone = frame(spark, [(1, "", 0)])
    left, other = store.delete_cascade(gone, "k", old, old.filter("t = 1"))
    assert rows(left) == [(2, "b", 1)] and rows(other) == [(2, "b", 1)]
    assert rows(store.mark(old, gone.union(gone), "k", "v", F.lit("m"))) == [(1, "m", 1), (1, "m", 2), (2, "b", 1)]
    kept, orphans = store.prune(old, gone, "k")
    assert (kept.count(), orphans.count()) == (2, 1)
    assert rows(store.last_wins(old, ["k"], "t")) == [(1, "a", 2), (2, "b", 1)]


def test_snapshots(spark, rows, tmp_path):
    table = SnapshotTable(spark, f"{tmp_path}/t", "k int, v string, t int")
    assert table.read().count() == 0 and table.versions() == []
    table.write(frame(spark, [(1, "a", 1)]))
    before = table.read()
    table.change(lambda old: store.upsert(old, frame(spark, [(2, "b", 2)]), ["k"]))
    assert rows(before) == [(1, "a", 1)] and rows(table.read()) == [(1, "a", 1), (2, "b", 2)]
    (tmp_path / "t" / "v=9").mkdir()
    assert table.versions() == [1, 2]
    table.vacuum(1)
    assert table.versions() == [2]


def test_bounded_broadcast(spark):
    df = spark.range(10)
    hinted = lambda x: "broadcast" in x._jdf.queryExecution().logical().toString().lower()
    assert hinted(bounded(df, 10)) and not hinted(bounded(df, 9))


def test_statistics_on_empty_tables(spark):
    chunks = spark.createDataFrame([], "doc_id string, strategy string, chunk_id string, chunk_index int, token_count int, embedded boolean")
    docs = spark.createDataFrame([("d",)], "doc_id string")
    assert statistics.chunk_stats(chunks).count() == 0
    base = statistics.knowledge_base(docs, chunks)
    assert base.first()["total_chunks"] == 0
    assert tuple(statistics.knowledge_totals(base.limit(0)).first()) == (0, 0, 0)
    assert statistics.has_all_chunks(docs, chunks, ["fixed"]).first()["complete"] is False


def test_metrics(spark):
    df = spark.createDataFrame([(["a"], ["b", "a"], True, False), ([], ["a"], False, True), (["a"], [], False, False)], "e array<string>, r array<string>, a boolean, f boolean")
    got = [tuple(r) for r in df.select(evaluation.hit("e", "r"), evaluation.refusal_correct("a", "f")).collect()]
    assert got == [(True, True), (None, True), (False, False)]
    parts = spark.createDataFrame([(3, 4), (9, 4), (0, 0)], "x int, n int")
    assert [r[0] for r in parts.select(evaluation.recall_fraction("x", "n")).collect()] == [0.75, 1.0, None]
    verdicts = spark.createDataFrame([(1, True), (1, None), (1, False), (1, True), (2, None)], "k int, v boolean")
    assert dict(map(tuple, verdicts.groupBy("k").agg(evaluation.share("v")).collect())) == {1: 0.6667, 2: None}


def test_summary_table(spark):
    samples = spark.createDataFrame([("fixed", "dense", True, False, True, True, 0.5, 1500), ("fixed", "dense", False, True, False, None, 0.2, 2500)], "strategy string, mode string, answerable boolean, refused boolean, cited boolean, hit boolean, confidence double, latency_ms long")
    grid = evaluation.summary(samples, ["strategy", "mode"])
    assert evaluation.format_table(grid, True).splitlines()[-1] == "| fixed | dense | 1.000 | 1.000 | 0.350 | 2,000 ms |"
    assert evaluation.aggregate(spark.createDataFrame([(1, 0.5, None), (1, None, None)], "k int, faithfulness double, answer_relevancy double"), ["k"], ("faithfulness", "answer_relevancy")).first()[1:] == (0.5, None)


def test_registry():
    entries = [e for c in corpora.CORPORA.values() for e in c]
    assert len(corpora.CORPORA["german_labour_law"]) == 26 and len(corpora.CORPORA["arxiv_nlp"]) == 5
    assert len({e[0] for e in entries}) == len(entries) and all(e[2].startswith("https://") for e in entries)


def test_registry_lookup(spark):
    with pytest.raises(KeyError):
        corpora.corpus(spark, "other")
    names = spark.createDataFrame([("KSchG.pdf",), ("kschg.txt",), ("My File.txt",)], "filename string")
    got = [(r["doc_id"], r["title"], r["category"]) for r in corpora.described(names, corpora.corpus(spark, "german_labour_law")).collect()]
    assert got == [("kschg", "Kündigungsschutzgesetz", "termination"), ("kschg", "Kündigungsschutzgesetz", "termination"), ("my file", "My File", "uploaded")]


def test_configuration():
    values = {"retrieval": {"top_k": "7", "expand": "no", "unknown": 1}, "embedding": {"model": "intfloat/multilingual-e5-large"}}
    found = config.load(values, {"VELITH_RETRIEVAL_MODE": "sparse", "VELITH_RETRIEVAL_TOP_K": "9"})
    assert (found.retrieval.top_k, found.retrieval.mode, found.retrieval.expand, found.embedding.dimension) == (9, "sparse", False, 1024)
    assert [config.coerce(x, bool) for x in ("1", "TRUE", " yes ", "on", "0", "no", "")] == [True] * 4 + [False] * 3
    assert config.coerce("a, b,", list) == ["a", "b"] and config.coerce("1.5", float) == 1.5


def test_question_set(spark, tmp_path):
    path = tmp_path / "q.json"
    path.write_text(json.dumps({"questions": [{"id": "q1", "question": "What?", "expected_docs": ["a"]}, {"id": "q2", "question": "Who?", "answerable": False}]}, indent=1))
    assert [(r["id"], r["answerable"]) for r in files.question_set(spark, str(path)).orderBy("id").collect()] == [("q1", True), ("q2", False)]


def test_incremental_ingestion(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "KSchG.txt").write_text("§ 1 Scope\nFirst rule here. Second rule here.\fSeite 2\n\n\fThird page. It ends.", encoding="utf-8")
    (folder / "other.txt").write_text("Some text. More text. Even more.", encoding="utf-8")
    (folder / "empty.txt").write_text("")
    base = KnowledgeBase(spark, f"{tmp_path}/kb")
    registry = corpora.corpus(spark, "german_labour_law")
    scan = lambda: files.scan(spark, f"{folder}", "*.txt")
    every = ["fixed", "sentence", "semantic"]
    assert ingest(base, scan(), registry, every) == {"seen": 2, "new": 2, "changed": 0, "skipped": 0, "pages": 3, "chunks": 7, "failures": 0}
    pages = base.pages.read().filter("doc_id = 'kschg'").orderBy("page_number").collect()
    assert [(p["page_number"], p["section"]) for p in pages] == [(1, "§ 1 Scope"), (3, "§ 1 Scope")]
    assert base.documents.read().filter("doc_id = 'kschg'").first()["title"] == "Kündigungsschutzgesetz"
    assert base.chunks.read().select("doc_id", "strategy").distinct().count() == 6
    assert ingest(base, scan(), registry, every) == {"seen": 2, "new": 0, "changed": 0, "skipped": 2, "pages": 0, "chunks": 0, "failures": 0}
    encode = encoder(dimension=8)
    n = base.chunks.read().count()
    assert embed(base, encode) == {"embedded": n, "pruned": 0}
    assert embed(base, encode) == {"embedded": 0, "pruned": 0}
    first = base.documents.read().filter("doc_id = 'other'").first()["ingested_at"]
    (folder / "other.txt").write_text("Quite another text.", encoding="utf-8")
    assert ingest(base, scan(), registry, every)["changed"] == 1
    again = base.documents.read().filter("doc_id = 'other'").first()
    assert again["ingested_at"] == first and isinstance(again["updated_at"], datetime)
    assert embed(base, encode)["pruned"] >= 1
    assert base.chunks.read().filter("not embedded").count() == 0
    base.delete(spark.createDataFrame([("other",)], "doc_id string"))
    assert {t.read().filter("doc_id = 'other'").count() for t in (base.documents, base.pages, base.chunks, base.points)} == {0}


def test_file_scan_and_magic(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"<html>")
    (tmp_path / "c.pdf").write_bytes(b"")
    found = files.scan(spark, str(tmp_path))
    assert sorted(r["filename"] for r in found.collect()) == ["a.pdf", "b.pdf"]
    assert [r["filename"] for r in files.with_magic(found).collect()] == ["a.pdf"]
    assert files.scan(spark, str(tmp_path), limit=1).count() == 1


def test_keys_too_many_to_broadcast_are_dealt_by_rows(spark, monkeypatch):
    from velith.operators import store

    table = spark.range(40).selectExpr("nullif(id, 39) AS id", "id AS v")
    gone = spark.range(0, 40, 2).union(spark.range(2))
    expected = sorted(v for v in range(40) if v == 39 or (v % 2 and v != 1))
    assert sorted(r["v"] for r in store.without(table, gone, "id").collect()) == expected
    monkeypatch.setattr(store, "bounded", lambda df: df)
    monkeypatch.setattr(store, "TASK_ROWS", 3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = store.without(table, gone, "id")
        assert large.rdd.getNumPartitions() == 14
        assert sorted(r["v"] for r in large.collect()) == expected
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
