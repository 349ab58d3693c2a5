"""A knowledge base searched, asked and evaluated; its logs; writers that meet; files that can't be read."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from velith import cli
from velith.operators import dense
from velith.plans import answering, evaluating, retrieval
from velith.plans.ingestion import KnowledgeBase, embed, ingest, same_dimension
from velith.sources import corpora, files, models
from velith.sources.snapshots import Conflict, SnapshotTable

TEXTS = {
    "leave": "Every worker has a claim to paid leave of four weeks. Leave is due each calendar year.",
    "notice": "Notice of termination must be given in writing. The period of notice is four weeks.",
    "rest": "After work there must be eleven hours of rest without a break. Night work needs a medical check.",
    "bad": "unreadable",
}


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("texts")
    for name, text in TEXTS.items():
        (folder / f"{name}.txt").write_text(text, encoding="utf-8")

    def reader(content: bytes):
        if content == b"unreadable":
            raise ValueError("no page here")
        yield content.decode(), []

    made = KnowledgeBase(spark, str(tmp_path_factory.mktemp("kb")))
    counters = ingest(made, files.scan(spark, str(folder), "*.txt"), corpora.corpus(spark, "arxiv_nlp"), ["sentence", "fixed"], reader)
    assert counters == {"seen": 4, "new": 4, "changed": 0, "skipped": 0, "pages": 3, "chunks": 6, "failures": 1}
    assert embed(made, models.encoder())["embedded"] == 6 and embed(made, models.encoder()) == {"embedded": 0, "pruned": 0}
    return made


def tables(base):
    shown = base.documents.read().select("doc_id", "category", "title")
    return base.chunks.read().join(shown, "doc_id"), base.points.read()


def asked(spark, *texts):
    return spark.createDataFrame([(f"q{k}", t) for k, t in enumerate(texts)], "qid string, text string")


@pytest.mark.parametrize("mode", ["dense", "sparse", "hybrid"])
def test_chunks_are_found_in_every_mode(spark, base, mode):
    questions = asked(spark, "claim to paid leave", "period of notice of termination", "zzz")
    found = retrieval.search_chunks(*tables(base), questions, "qid", models.encoder(), mode).join(base.chunks.read().withColumnRenamed("chunk_id", "id"), "id")
    best = {r["qid"]: r["doc_id"] for r in found.filter("rank = 1").select("qid", "doc_id").collect()}
    assert best["q0"] == "leave" and best["q1"] == "notice"
    assert ("q2" in best) == (mode != "sparse")


@pytest.mark.parametrize("mode", ["dense", "sparse", "hybrid"])
def test_filters_hold_for_both_retrievers(spark, base, mode):
    questions = asked(spark, "four weeks of leave and notice")
    for options in ({"doc_ids": ["notice"]}, {"doc_ids": ["notice"], "category": "uploaded"}):
        found = retrieval.search_chunks(*tables(base), questions, "qid", models.encoder(), mode, **options).collect()
        assert found and all("notice" in r["id"] for r in found)
    assert retrieval.search_chunks(*tables(base), questions, "qid", models.encoder(), mode, category="none such").isEmpty()


def test_unknown_mode_and_missing_encoder(spark, base):
    with pytest.raises(ValueError, match="unknown mode"):
        retrieval.search_chunks(*tables(base), asked(spark, "x"), "qid", None, "other")
    with pytest.raises(ValueError, match="encoder"):
        retrieval.search_chunks(*tables(base), asked(spark, "x"), "qid", None, "dense")


def test_query_blocks_give_what_one_block_gives(spark):
    vectors = spark.createDataFrame([(f"v{k}", [float(k % 7), 1.0, float(k % 3)]) for k in range(60)], "id string, v array<double>")
    one, many = (sorted(map(tuple, dense.top_k(vectors, vectors, 4, id_col="id", query_col="id", vector_col="v", query_block=n).collect())) for n in (1000, 9))
    assert one == many and len(one) == 240


def test_stored_record_wins_unless_empty(spark, base):
    results = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, rank int")
    records = spark.createDataFrame([("a", "T", 3), ("b", "", 0)], "id string, title string, page_start int")
    payload = spark.createDataFrame([("a", "old", 1), ("b", "kept", 2), ("c", "only", 5)], "id string, title string, page_start int")
    got = retrieval.overridden(results, records, payload, ["title", "page_start"]).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [("a", 1, "T", 3), ("b", 2, "kept", 2), ("c", 3, "only", 5)]


QUESTIONS = [
    ("1", "How long is the claim to paid leave?", "Every worker has a claim to paid leave of four weeks.", ["leave"], True),
    ("2", "What holds for notice of termination?", "Notice of termination must be given in writing.", ["notice"], True),
    ("3", "qqq xyzzy", "", [], False),
]


def test_evaluation_grid(spark, base):
    questions = spark.createDataFrame(QUESTIONS, "id string, question string, ground_truth string, expected_docs array<string>, answerable boolean")
    rows = evaluating.run(*tables(base), questions, ["sentence", "fixed"], ["sparse", "hybrid"], models.encoder(), models.generator(), evaluating.Judge(), below=0.01)
    assert rows.count() == 12
    by = {(r["strategy"], r["mode"], r["question_id"]): r for r in rows.collect()}
    one, refused = by["sentence", "sparse", "1"], by["sentence", "sparse", "3"]
    assert one["hit"] and one["cited"] and not one["refused"] and one["retrieved_docs"][0] == "leave"
    assert one["faithfulness"] == 1.0 and one["context_recall"] == 1.0 and 0 < one["context_precision"] <= 1 and 0 <= one["answer_relevancy"] <= 1
    assert refused["refused"] and refused["hit"] is None and all(refused[m] is None for m in evaluating.METRICS)
    cells = {(r["strategy"], r["mode"]): r for r in evaluating.summary(rows).collect()}
    assert len(cells) == 4 and cells["sentence", "sparse"]["retrieval_hit_rate"] == 1.0 and cells["sentence", "sparse"]["refusal_accuracy"] == 1.0
    base.logs.log_evaluations(evaluating.result_rows(rows, "first"))
    base.logs.log_experiment("first", {"modes": ["sparse"]}, {"hit": 1.0, "name": "text", "none": None}, rows)
    assert base.logs.evaluations.read().filter("run_label = 'first'").count() == 12
    kept = base.logs.experiments.read().first()
    assert kept["metrics"] == {"hit": 1.0} and len(json.loads(kept["samples"])) == 12
    assert max(len(c) for s in json.loads(kept["samples"]) for c in s["contexts"]) <= 200


def test_answers_with_instructions_and_history(spark, base):
    questions = asked(spark, "What about paid leave?")
    chunks, points = tables(base)
    own = chunks.withColumn("id", F.col("chunk_id"))
    results = retrieval.search_chunks(chunks, points, questions, "qid", None, "sparse")
    history = spark.createDataFrame([("q0", 2, "first?", "one"), ("q0", 1, "second?", "two")], "qid string, turn_rank int, question string, answer string")
    seen = answering.answer(questions, results, own, "qid", "sparse", lambda p: p, below=0.0, domain="labour law", history=history).first()["answer"]
    assert seen.startswith("You answer questions about labour law in English") and seen.index("first?") < seen.index("second?") < seen.rindex("What about paid leave?")
    full = answering.answer(questions, results, own, "qid", "sparse", models.generator(), below=0.0)
    told = list(answering.events(full, "qid"))
    assert [e["event"] for e in told][0] == "sources" and told[-1]["event"] == "done" and len(told) > 3
    assert base.logs.log_queries(answering.log_rows(full, "qid", "sentence", "sparse", "m")) and base.logs.queries.read().count() == 1
    said = []
    assert not base.logs.log_queries(full.select(F.raise_error(F.lit("broken")).alias("question")), said.append) and said


def test_runs_are_logged(spark, base):
    run = base.logs.runs().first()
    assert run["status"] == "success" and (run["documents_seen"], run["chunks_written"]) == (4, 6) and run["finished_at"] >= run["started_at"]
    other = base.logs.start_run("c", "s")
    assert {r["run_id"]: r["status"] for r in base.logs.runs().collect()}[other] == "running"
    base.logs.finish_run(other, {}, "no disk")
    assert [tuple(r) for r in base.logs.runs().filter(F.col("run_id") == other).select("status", "error").collect()] == [("failed", "no disk")]


def test_dimensions_must_agree(spark, base):
    with pytest.raises(ValueError, match="dimensions"):
        same_dimension(spark.createDataFrame([([1.0],)], "vector array<float>"), base.points.read())


def test_writers_that_meet(spark, tmp_path):
    table = SnapshotTable(spark, f"{tmp_path}/t", "k string, v int", key="k", buckets=4)
    rows = lambda *x: spark.createDataFrame(list(x), "k string, v int")
    table.write(rows(*((f"k{i}", i) for i in range(20))))
    first, parts = table._base()
    table.append(rows(("new", 1)))
    with pytest.raises(Conflict):
        table._commit(first, parts)
    tries = []

    def slow(old):
        tries.append(1)
        if len(tries) == 1:
            table.append(rows(("meanwhile", 2)))  # another writer is faster
        return old.filter("k != 'k3'")

    table.change(slow)
    got = {r["k"]: r["v"] for r in table.read().collect()}
    assert len(tries) == 2 and "k3" not in got and {"new", "meanwhile", "k4"} <= got.keys() and len(got) == 21


def test_a_change_takes_over_untouched_buckets(spark, tmp_path):
    table = SnapshotTable(spark, f"{tmp_path}/t", "k string, v int", key="k", buckets=8)
    rows = lambda *x: spark.createDataFrame(list(x), "k string, v int")
    table.write(rows(*((f"k{i}", i) for i in range(50))))
    before = {p["bucket"]: p["folder"] for p in table._base()[1]}
    table.change(lambda old: old.filter("k != 'k7'").unionByName(rows(("k7", 700))), touched=rows(("k7", 0)))
    after = {p["bucket"]: p["folder"] for p in table._base()[1]}
    assert sum(before[b] != after[b] for b in before) == 1
    assert {r["k"]: r["v"] for r in table.read().collect()} == {**{f"k{i}": i for i in range(50)}, "k7": 700}
    table.vacuum(1)
    assert table.read().count() == 50


def test_evaluate_command(spark, base, tmp_path, capsys):
    path = tmp_path / "questions.json"
    path.write_text(json.dumps({"questions": [{"id": a, "question": b, "ground_truth": c, "expected_docs": d, "answerable": e} for a, b, c, d, e in QUESTIONS]}), encoding="utf-8")
    where = base.documents.path.removesuffix("/documents")
    assert cli.main(["--base", where, "evaluate", str(path), "--mode", "sparse", "--retrieval-only", "--label", "cli"]) == 0
    assert "| sentence | sparse | 1.000 |" in capsys.readouterr().out
    assert base.logs.evaluations.read().filter("run_label = 'cli'").count() == 3
