"""Cleaning, headings, tables, sentences, tokens and ids, against plain Python."""

from __future__ import annotations

import hashlib
import re
import uuid

import pytest
from pyspark.sql import functions as F

from velith.functions import ids, lexicon, text


def value(spark, expr, data, kind="string"):
    return [r[0] for r in spark.createDataFrame([(k, x) for k, x in enumerate(data)], f"k int, x {kind}").select("k", expr.alias("y")).orderBy("k").select("y").collect()]


@pytest.mark.parametrize(
    ("line", "heading"),
    [
        ("§ 1 Scope", "§ 1 Scope"),
        ("  §  12a   Rest  periods ", "§ 12a Rest  periods"),
        ("§§ 3 bis 5", "§§ 3 bis 5"),
        ("ARTIKEL 7", "ARTIKEL 7"),
        ("Abschnitt IV General", "Abschnitt IV General"),
        ("kapitel 2", "kapitel 2"),
        ("3.1 Related Work", "3.1 Related Work"),
        ("3.1 ab", None),
        ("An employee has a claim", None),
        ("", None),
        ("   ", None),
        ("§ 1 " + "x" * 300, None),
        (None, None),
    ],
)
def test_heading(spark, line, heading):
    assert value(spark, text.detect_section("x"), [line]) == [heading]


def test_noise_lines(spark):
    lines = ["- Seite 3 von 12 -", "Seite 4", " 17 ", "www.gesetze-im-internet.de", "Seite 4 and more", "A rule", "Ein Service des Bundesministeriums der Justiz und anderer"]
    assert value(spark, text.is_noise("x"), lines) == [True, True, True, True, False, False, True]


def test_clean_text_and_first_section(spark):
    raw = "Seite 3\n§ 2  Leave\n\n\n\nTwo   words\there \t now.  \r\n12\nEnd.  "
    assert value(spark, text.clean_text("x"), [raw, "", None]) == ["§ 2 Leave\n\nTwo words\there now.\nEnd.", "", None]
    assert value(spark, text.first_section("x"), [raw, "none", None]) == ["§ 2 Leave", None, None]


def test_table_to_markdown(spark):
    tables = [[["a", None], ["b\nc", "d", " e "], [], ["", None]], [["", None]], []]
    assert value(spark, text.table_to_markdown("x"), tables, "array<array<string>>") == ["| a |  |  |\n| --- | --- | --- |\n| b c | d | e |", "", ""]


def sentences(raw: str) -> list[str]:
    """The rule as a loop: cut, trim, glue after abbreviations."""
    out: list[str] = []
    for piece in re.split(r"(?<=[.!?:;])\s+(?=[A-ZÄÖÜ§(])", raw):
        piece = piece.strip()
        if piece and out and any(out[-1].endswith(a + ".") for a in lexicon.ABBREVIATIONS):
            out[-1] += " " + piece
        elif piece:
            out.append(piece)
    return out


def test_sentences_equal_the_loop(spark):
    raws = ["See Abs.  3 and Abs.\n§ 4. It ends! (So) it does: Yes; No", "One.", "  ", "", "Nr. A. B. C", "a. b. c", "Satz. Ein S. Zwei. Drei", "x" * 50 + ". Y", "End of S.\n\n(1) Next. i.V.m. § 3. Then"]
    assert value(spark, text.split_sentences("x"), raws) == [sentences(r) for r in raws]
    assert value(spark, text.split_sentences("x"), [None]) == [None]


def test_tokens_and_terms(spark):
    assert value(spark, text.count_tokens("x"), ["a b  c\n", "  ", "", None]) == [3, 0, 0, 0]
    assert value(spark, text.terms("x"), ["Die § 12abc Kündigung und x the BGB2020"]) == [["§", "12a", "bc", "kündigung", "bgb2020"]]


def test_ids_equal_the_library(spark):
    df = spark.createDataFrame([("d", "fixed", 7, "täxt"), ("d", "", 123456, "b"), ("d", None, 1, None)], "d string, s string, k int, t string")
    found = [r[0] for r in df.select(ids.chunk_id("d", "s", "k", "t")).collect()]
    expected = []
    for d, s, k, t in [("d", "fixed", 7, "täxt"), ("d", "", 123456, "b"), ("d", "", 1, "")]:
        digest = hashlib.sha1(f"{d}|{s}|{k}|{t}".encode()).hexdigest()[:16]
        expected.append("_".join(x for x in (d, s, f"{k:05d}", digest) if x))
    assert found == expected
    names = ["chunk", "", "ä" * 99]
    assert value(spark, ids.uuid5("x"), names) == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]
    assert value(spark, ids.content_hash("x"), ["ä", None]) == [hashlib.sha256("ä".encode()).hexdigest(), None]


def test_functions_stay_in_the_jvm(spark):
    df = spark.createDataFrame([("x",)], "x string").select(text.clean_text("x"), text.split_sentences("x"), text.terms("x"), F.lit(1))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_white_space_is_named_the_same_way_everywhere():
    """The characters that are trimmed are those that the pattern of white space fits."""
    import re

    from velith.functions import lexicon as lx

    plain = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: chr(int(m[1], 16)), lx.WS)
    assert set(lx.SPACES) == {chr(c) for c in range(0x10000) if re.fullmatch(plain, chr(c))}


def test_cuts_need_no_character_that_a_text_may_have(spark):
    raws = ["One. Two￿. See Abs. ￿. Three! (Four) Nr.  5. Six", "￿", "A.　B.\n\nÄ"]
    assert value(spark, text.split_sentences("x"), raws) == [sentences(r) for r in raws]
    plan = spark.createDataFrame([("x",)], "x string").select(text.split_sentences("x"))._jdf.queryExecution().executedPlan().toString()
    assert lexicon.CUT in plan and "filter(" not in plan


def test_tokens_at_any_white_space(spark):
    """Blanks alone are cut at without a pattern; any other white space still counts."""
    raws = ["a b", " a  b ", *(f"a{c}b {c}c" for c in lexicon.SPACES), "ä ö", "a​b"]
    assert value(spark, text.count_tokens("x"), raws) == [2, 2, *[3] * len(lexicon.SPACES), 2, 1]
    plan = spark.createDataFrame([("x",)], "x string").select(text.count_tokens("x"))._jdf.queryExecution().executedPlan().toString()
    assert "array_remove(split(" in plan


def test_a_table_is_cleaned_once(spark):
    """Cells are cleaned once, not anew for each row, the rule and the test for an empty table."""
    rows = [[["a"] * (1 + k % 3) for k in range(40)], [None, ["x"], None], [None], None]
    body = ["| " + " | ".join(["a"] * (1 + k % 3) + [""] * (2 - k % 3)) + " |" for k in range(40)]
    expected = ["\n".join([body[0], "| --- | --- | --- |", *body[1:]]), "| x |\n| --- |", "", None]
    assert value(spark, text.table_to_markdown("x"), rows, "array<array<string>>") == expected
    df = spark.createDataFrame([(1, [["x"]])], "k int, x array<array<string>>").repartition(2).select(text.table_to_markdown("x").alias("y"))
    assert df._jdf.queryExecution().executedPlan().toString().count("trim(") == 1
