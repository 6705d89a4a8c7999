"""Language identification: features against a plain count, held-out accuracy, and defined results."""

import math
import random
from collections import Counter

import numpy as np
from granary.llm import language as lang
from pyspark.sql import functions as F

SYLLABLES = {"xx": "ba be bi bo lo la", "yy": "tch grr st ck end rng", "zz": "ña çõ é à ê oi"}


def said(language, seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(SYLLABLES[language].split(), k=3)) for _ in range(n))


def test_ngram_counts_agree_with_a_plain_count(monkeypatch):
    texts = ["Ab  ab\tABC", "", None, "é🙂 é🙂", "abc" * 50, "x"]
    whole = [lang.ngram_counts(t) for t in texts]
    for text, (feature, n) in zip(texts, whole):
        spaced = f" {' '.join((text or '').lower().split())} "
        grams = Counter(spaced[a : a + k] for k in lang.ORDERS for a in range(len(spaced) - k + 1))
        # no hashes meet in texts this short
        assert sorted(n) == sorted(grams.values()) and len(set(feature)) == len(grams)
    for piece in (1, 2, 7, 64):
        monkeypatch.setattr(lang, "PIECE", piece)
        for text, (feature, n) in zip(texts, whole):
            assert all((a == b).all() for a, b in zip(lang.ngram_counts(text), (feature, n)))


def test_held_out_rows_of_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = lang.op13_language(spark, sf)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == docs.count()
    right, n, low, high = got.join(docs.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.min("score"), F.max("score")).first()
    assert n > 100 and right > 0.97 and 0 <= low <= high <= 1
    assert docs.where("text is not null").count() == got.where("lang_pred <> 'und'").count()


def test_defined_results(spark):
    rows = [(i, said(x, (x, i).__repr__(), 20), x) for i in range(30) for x in SYLLABLES]
    rows += [(1, rows[0][1], "xx"), (500, None, "xx"), (501, "12 34!", "xx"), (502, "", None), (503, said("zz", 1, 150_000), None), (None, said("yy", 2, 5), "yy")]
    docs = spark.createDataFrame([(*r, "own") for r in rows], "id long, text string, lang string, feature string")
    model = lang.train(docs)
    assert model.langs == ["xx", "yy", "zz"] and 0.05 < model.temperature <= 20
    got = lang.identify(docs, model)
    assert got.columns == [*docs.columns, "lang_pred", "score"]
    for r in got.collect():
        if r["id"] in (500, 501, 502):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] == (r["lang"] or "zz") and 1 / 3 <= r["score"] <= 1
    again = lang.train(docs)
    assert (model.weights == again.weights).all() and model.temperature == again.temperature
    one = lang.train(docs.where("lang = 'yy'"))
    assert {(r["lang_pred"], r["score"]) for r in lang.identify(docs.where("id < 5"), one).collect()} == {("yy", 1.0)}
    none = lang.train(docs.limit(0))
    assert {(r["lang_pred"], r["score"]) for r in lang.identify(docs, none).collect()} == {("und", 0.0)}
    assert lang.identify(docs.limit(0), model).count() == 0
    # with room for few rows every language still has some
    assert lang.train(docs, 9).langs == ["xx", "yy", "zz"]


def test_document_frequencies_cover_all_rows(spark):
    texts = ["ab", "ab", "b", None, ""]
    total, found = lang.document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    plain = sum((Counter(lang.ngram_counts(t)[0].tolist()) for t in texts), Counter())
    assert total == 5 and {i: n for i, n in enumerate(found) if n} == dict(plain)


def test_temperature_is_the_best_of_many():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, 400)
    z = rng.normal(0, 3, (400, 3)) + 4 * np.eye(3)[y]
    target = np.full((400, 3), 1 / 403)
    target[np.arange(400), y] = 401 / 403
    loss = lambda t: -float(np.sum(target * np.log(lang.softmax(z / t))))
    best = lang.temperature(z, y)
    assert all(loss(best) <= loss(t) + 1e-6 for t in np.exp(np.linspace(math.log(0.05), math.log(20), 200)))
