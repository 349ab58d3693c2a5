"""Language identification on texts whose language is known."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from velith.llm import language_id as li

WORDS = {
    "en": "the of and to in that is was for with they have this from which would there their about",
    "de": "der die und den von das mit sich des auf für ist nicht ein eine auch werden aus hat über",
    "fr": "le la les des et du une que dans qui pour pas sur est avec par plus être où même",
    "es": "el los las del que una por con para como más pero sus este también hasta desde año está según",
}


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(0)
    rows = []
    for k in range(240):
        lang = list(WORDS)[k % 4]
        rows.append((k, " ".join(rng.choice(WORDS[lang].split(), int(rng.integers(8, 60)))), lang))
    rows += [(900, None, "en"), (901, "", "de"), (902, "123 ...", "fr"), (903, "the of and " * 40000, None), (904, "der", "de"), (904, "der", "de"), (None, "les des une", "fr")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("s")).withColumn("id", F.lit("clash")).withColumn("k", F.lit(0))


def test_held_out_accuracy(docs):
    found = li.predict(docs, li.train(docs)).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in found if r["held_out"] and r["doc_id"] < 900]
    assert len(held) > 30 and np.mean([r["lang"] == r["lang_pred"] for r in held]) >= 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    assert all(0 <= r["score"] <= 1 for r in found)
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in found}
    assert by[900] == by[901] == by[902] == ("und", 0.0) and by[903][0] == "en"


def test_predictions_need_the_text_alone(docs):
    model = li.train(docs)
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None))
    assert sorted(map(repr, li.predict(other, model).collect())) == sorted(map(repr, li.predict(docs, model).collect()))


def test_held_out_rows_teach_nothing(docs):
    wrong = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, "zz").otherwise(F.col("lang")))
    model = li.train(wrong)
    assert sorted({x for names in model.languages.values() for x in names}) == ["de", "en", "es", "fr"]
    assert model.families == ["germanic", "romance"]


def test_few_languages(spark):
    one = spark.createDataFrame([(k, "abc def", "en") for k in range(8)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in li.predict(one, li.train(one)).collect()} == {"en"}
    none = one.withColumn("lang", F.lit(None).cast("string"))
    assert {(r["lang_pred"], r["score"]) for r in li.predict(none, li.train(none)).collect()} == {("und", 0.0)}
    assert li.predict(one.limit(0), li.train(one.limit(0))).count() == 0


def test_features_do_not_depend_on_the_batch():
    texts = ["abc", "", "xyz " * 500, "ä", "ab"]
    assert np.allclose(li.features(texts), np.concatenate([li.features([t]) for t in texts]))


def test_held_out_accuracy_on_the_shared_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = li.predict(docs, li.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null and lang_pred != 'und'").select("lang", "lang_pred").collect()
    assert len(found) > 50 and sum(r["lang"] == r["lang_pred"] for r in found) >= 0.97 * len(found)
