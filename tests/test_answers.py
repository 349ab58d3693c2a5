"""Questions, prompts, citations, refusals and answers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from velith.functions import answers as a
from velith.operators.context import remembered, system_prompt, user_prompt, within_budget
from velith.operators.fusion import single
from velith.plans import answering
from velith.sources import models


def one(spark, expr, x, kind="string"):
    return spark.createDataFrame([(x,)], f"x {kind}").select(expr).first()[0]


@pytest.mark.parametrize(
    ("answer", "n", "cites"),
    [("Yes [1].", 3, [1]), ("[1][2]", 3, [1, 2]), ("[1, 2]", 3, [1, 2]), ("[5]", 3, []), ("[0]", 3, []), ("[see 2]", 3, []), ("[1, § 3 Abs. 1]", 5, [1]), ("[2] and [2] and [1]", 5, [1, 2]), ("none", 3, []), ("", 3, []), ("[99999999999999999999]", 3, []), ("[" + "1" * 130 + "]", 3, [])],
)
def test_citations(spark, answer, n, cites):
    assert one(spark, a.extract_citations("x", n), answer) == cites


@pytest.mark.parametrize(
    ("question", "language"),
    [("Wie viele Urlaubstage stehen mir zu?", "German"), ("How many days of leave do I have?", "English"), ("KSchG § 1", "German"), ("", "English"), ("the der", "English"), ("Kündigung", "German")],
)
def test_language(spark, question, language):
    assert one(spark, a.detect_language("x"), question) == language


def test_expansions(spark):
    assert one(spark, a.expansions("x"), "Wie lange ist die Kündigungsfrist?") == ["die Kündigungsfrist", "lange kündigungsfrist"]
    assert one(spark, a.expansions("x"), "Was sagt Paragraf 3 Absatz 2 Satz 1?")[0] == "Was sagt § 3 abs. 2 s. 1?"
    assert one(spark, a.expansions("x"), "Der Grundsatz gilt")[0] == "Der Grunds. gilt"
    assert one(spark, a.expansions("x"), "kündigung") == []
    assert len(one(spark, a.expansions("x", 1), "How long is Artikel 3 of it?")) == 1


def test_refusals_and_cuts(spark):
    assert one(spark, a.is_refusal("x"), "Sorry, I DON'T know that") is True
    assert one(spark, a.is_refusal("x"), "It is 24 days [1]") is False
    assert one(spark, a.excerpt("x", 10), "aaa bbb ccc ddd") == "aaa bbb […]"
    assert one(spark, a.excerpt("x", 10), "a" * 15) == "a" * 10 + " […]"
    assert one(spark, a.excerpt("x", 10), None) == ""
    assert one(spark, a.preview("x", 3), "abcd") == "abc…"
    assert one(spark, a.strip_citations("x"), " So [1] it [1, 2] is[3] ") == "So  it [1, 2] is"
    assert one(spark, a.claims("x"), "Short. This sentence is long enough [1]. And so is this one!") == ["This sentence is long enough .", "And so is this one!"]


def test_citation_string(spark):
    rows = [("T", "d", "§ 1", 2, 2), ("", "d", None, 2, 4), (None, "d", "", 1, None)]
    df = spark.createDataFrame(rows, "t string, d string, s string, a int, b int")
    assert [r[0] for r in df.select(a.citation("t", "d", "s", "a", "b")).collect()] == ["T, § 1, p. 2", "d, pp. 2-4", "d, p. 1"]


def test_json_repair(spark):
    cases = {'{"a": 1}': '{"a": 1}', 'Sure: {"a": [1]} ok': '{"a": [1]}', "[{]": None, "nothing": None, "": None, "} {": None}
    for raw, expected in cases.items():
        assert one(spark, a.repaired_json("x"), raw) == expected


def budgeted(texts: list[str | None], budget: int = 8000, least: int = 200) -> list[str]:
    out, used = [], 0
    for t in texts:
        t = t or ""
        if used + len(t) > budget:
            left = budget - used
            if left < least:
                break
            t = t[:left].rsplit(" ", 1)[0] + " […]"
        used += len(t)
        out.append(t)
    return out


@pytest.mark.parametrize("texts", [[], ["a b"] * 3, ["word " * 30] * 4, ["x" * 500, "tail of it"], [None, "a" * 90, "b c " * 10, "d"], ["y" * 95, "z z z z", "w"]])
def test_context_budget_equals_the_loop(spark, texts):
    assert one(spark, within_budget("x", 100, 20), texts, "array<string>") == budgeted(texts, 100, 20)


def test_prompts(spark):
    df = spark.createDataFrame([("Wie lange?", ["A, p. 1", "B, p. 2"], ["eins", "zwei"], [("q", "r")])], "q string, c array<string>, t array<string>, h array<struct<question:string,answer:string>>")
    row = df.select(system_prompt("q", "labour law").alias("s"), user_prompt("q", "c", "t", "h").alias("u")).first()
    assert "German" in row["s"] and "Ich weiß es nicht." in row["s"]
    assert row["u"] == "Earlier:\nQ: q\nA: r\n\n[1] A, p. 1\neins\n\n[2] B, p. 2\nzwei\n\nQuestion: Wie lange?"


def test_memory(spark):
    turns = spark.createDataFrame([("s", k, k == 4) for k in range(6)] + [("t", 0, None)], "session string, turn int, refused boolean")
    got = {(r["session"], r["turn"]) for r in remembered(turns, ["session"], ["turn"]).collect()}
    assert got == {("s", 5), ("s", 3), ("s", 2), ("t", 0)}


def test_request_errors(spark):
    rows = [("ab", "s", "dense", None, None), ("    ", "s", None, None, 1), ("fine", "s" * 129, None, None, 1), ("fine", "s", "x", None, 1), ("fine", "s", None, "x", 1), ("fine", None, "hybrid", "fixed", 21), ("fine", "s", "sparse", "semantic", 20), (None, "s", None, None, 1), ("x" * 1001, "s", None, None, 1)]
    df = spark.createDataFrame(rows, "q string, s string, m string, p string, k int")
    assert [r[0] for r in df.select(a.request_error("q", "s", "m", "p", "k")).collect()] == ["question length", "question blank", "session_id length", "mode", "strategy", "top_k", None, "question length", "question length"]


def test_answers_end_to_end(spark):
    chunks = spark.createDataFrame([(1, "Law", "d1", "§ 1", 1, 2, "Leave is 24 days. More here."), (2, None, "d2", None, 3, 3, "Pay is due monthly. And so on.")], "id int, title string, doc_id string, section string, page_start int, page_end int, text string")
    asked = spark.createDataFrame([(1, "How long is leave?"), (2, "Was ist es?"), (3, None)], "q int, text string")
    found = spark.createDataFrame([(1, 1, 1, 30.0), (1, 2, 2, 20.0), (2, 1, 2, 0.5)], "q int, rank int, id int, score double")
    rows = {r["q"]: r for r in answering.answer(asked, single(found, "q", "sparse"), chunks, "q", "sparse", models.generator()).collect()}
    assert rows[1]["answer"] == "Leave is 24 days. [1] Pay is due monthly. [2]" and rows[1]["cited"] and not rows[1]["refused"]
    assert [s["citation"] for s in rows[1]["sources"]] == ["Law, § 1, pp. 1-2", "d2, p. 3"] and all(s["cited"] for s in rows[1]["sources"])
    assert rows[2]["refused"] and rows[2]["answer"] == "Ich weiß es nicht." and not rows[2]["cited"]
    assert rows[3]["refused"] and rows[3]["sources"] == []
    log = answering.log_rows(answering.answer(asked, single(found, "q", "sparse"), chunks, "q", "sparse", models.generator()), "q", "fixed", "sparse", "stand-in")
    assert log.filter("session_id = 1").first()["chunk_ids"] == ["1", "2"]


def test_models(spark):
    assert models.resolve_model(["a:7b", "b"], "a", "b") == "a:7b"
    assert models.resolve_model(["c", "b:1"], "a", "b") == "b:1"
    assert models.resolve_model(["c"], "a", "b") == "c"
    with pytest.raises(ValueError):
        models.resolve_model([], "a", "b")
    encode = models.encoder(dimension=16)
    v = one(spark, encode(F.col("x")), "leave leave pay")
    assert len(v) == 16 and sum(x * x for x in v) == pytest.approx(1, abs=1e-5)
    assert one(spark, models.overlap_judge(F.col("x"), F.lit("the leave is 24 days")), "leave is long") is True


def test_only_texts_that_were_found_meet_the_results(spark):
    from velith.plans import answering

    chunks = spark.createDataFrame([(k, f"text {k}") for k in range(9)], "id long, text string")
    results = spark.createDataFrame([(1, 4), (2, 4), (2, 7), (3, 77), (4, None)], "q int, id long")
    found = answering.found_in(chunks, results)
    assert sorted(r["id"] for r in found.collect()) == [4, 7]
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()


def test_citations_are_those_of_a_loop_by_one_pattern(spark):
    import random
    import re

    def loop(text):
        groups = [re.match(r"\s*([0-9]+(?:\s*,\s*[0-9]+)*)", g) for g in re.findall(r"\[([^\]\[]{0,120})\]", text)]
        return sorted({int(n) for g in groups if g for n in g[1].split(",") if 1 <= int(n) <= 12})

    draw = random.Random(7)
    texts = ["[99999999999, 2]", ",5 [1", "[1] , 2", "[ 3\n,　4,x, 5]", "[" + "1," * 60 + "1]", "[" + "1," * 59 + "2]", "", "[1,,2]"]
    texts += ["".join(draw.choices("[],0123 \t a", weights=[4, 4, 4, 1, 3, 3, 3, 3, 1, 1, 1], k=draw.randrange(40))) for _ in range(3000)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, x string").select("k", a.extract_citations("x", 12).alias("c"))
    assert {r["k"]: r["c"] for r in df.collect()} == {k: loop(t) for k, t in enumerate(texts)}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract") == 1 and "flatten" not in plan
