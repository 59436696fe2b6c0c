"""Classifiers: held-out accuracy, contract columns and odd rows."""

import zlib

import pytest
from pyspark.sql import functions as F

from tidepool.llm import language, quality, subword
from tidepool.llm.queries import QUERIES


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def test_quality_query(spark, data_dir):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data_dir}/labels.parquet").collect()}
    rows = QUERIES["op4_quality"](spark, data_dir).collect()
    assert len(rows) == spark.read.parquet(f"{data_dir}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (crc(r["doc_id"]) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    judged = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for s, y in judged if y], [s for s, y in judged if not y]
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad)) > 0.95


def test_language_query(spark, data_dir):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op9_language"](spark, data_dir).collect()
    assert len(rows) == len(lang)
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (crc(r["doc_id"]) % 3 == 1) for r in rows)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.97
    assert sum(r["accepted"] for r in held) / len(held) > 0.9


def test_models_on_odd_rows(spark, make_docs):
    words = {"en": "the quick house over there is with", "de": "das schnelle haus ist über dort mit"}
    rows = [(i, " ".join((words[lang] + f" {i}").split()[i % 3 :]), lang, None, 0) for i in range(120) for lang in [("en", "de")[i % 2]]]
    rows += [(900, None, "en", None, 0), (901, "", None, None, 0), (902, "123 456 !!", None, None, 0), (903, "haus ist über mit", None, None, 0), (None, "the house is", None, None, None), (5, "das haus", "de", None, 0)]
    rows += [(904, "the house with " * 60_000, None, None, 0)]
    docs = make_docs(rows).withColumn("score", F.lit("clash"))
    got = language.identify(docs).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    assert [by_id[i]["lang_pred"] for i in (900, 901, 902, 903, 904)] == ["und", "und", "und", "de", "en"]
    assert by_id[900]["score"] == 0.0 and language.identify(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(120)] + [(7, None, "x"), (8, 1, "x"), (None, 1, "x"), (10**6, 0, "x")], "doc_id long, quality int, score string")
    scored = {r["doc_id"]: r for r in quality.scores(docs, labels).collect()}
    assert scored[903]["score"] > 0.5 > scored[904]["score"]
    assert {r["score"] for r in quality.scores(docs, labels.limit(0)).collect()} == {0.5}


def test_long_texts_count_whole():
    model = subword.fit(["aaa bbb"] * 60 + ["ccc ddd"] * 60, ["a"] * 60 + ["c"] * 60, lower=True)
    long = "aaa bbb " * 40_000
    assert model.probabilities([long])[0][0] > 0.9
    assert model.probabilities([long + "ccc ddd " * 400_000])[0][0] < 0.5
    alone, batch = model.probabilities(["aaa ccc"])[0], model.probabilities(["x" * 10, "aaa ccc", ""])[1]
    assert alone == pytest.approx(batch)
