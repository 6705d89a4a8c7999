"""Extra columns with the operators' own names, repeated rows, long texts and empty tables."""

import random

import pytest
from granary.llm import chat, decontaminate, mixing, neardup, passages, quality, toxicity
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
EXTRA = "tox_score cr_row cr_cuts cr_id cr_doc cr_hash x_id x_spans nd_key nd_id nd_other dc_doc dc_hash x_doc x_hash mx_id mx_key id text_ site path p class_id key".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))


@pytest.fixture(scope="module")
def crowded(spark):
    """A few documents, one very long, one repeated, with columns of all the names that operators use inside."""
    a = prose(1, 120)
    rows = [(1, a, "en", "s"), (2, a, "en", "s"), (2, a, "en", "s"), (3, prose(2, 60_000), "en", "t"), (4, "", "en", "t"), (None, None, None, None), (5, prose(3, 90) + " " + a, "fr", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in EXTRA])


@pytest.mark.parametrize("stage", [toxicity.filter_toxic, neardup.keep_one, passages.cut_repeats, decontaminate.filter_leaks])
def test_stages_keep_columns_of_any_name(spark, crowded, stage):
    got = stage(spark, crowded, SF)
    assert got.columns == crowded.columns
    rows = got.collect()
    assert rows and all(r[c] == f"own {c}" for r in rows for c in EXTRA)
    assert max(len(r["text"] or "") for r in rows) == 6 * 60_000 - 1
    assert stage(spark, crowded.limit(0), SF).count() == 0


def test_operators_read_columns_of_any_name(spark, crowded):
    assert {(r[0], r[1]) for r in neardup.classes(crowded).collect()} == {(1, 1), (2, 1), (3, 3), (4, 4), (None, None), (5, 5)}
    assert {(r["doc_id"], r["start"], r["stop"]) for r in passages.repeats(crowded).collect()} == {(2, 0, 120), (5, 90, 210)}
    assert mixing.mix(crowded).count() == quality.rate_documents(crowded, spark.read.parquet(f"{SF}/labels.parquet")).count() == 7
    renamed = crowded.drop("id").withColumnRenamed("doc_id", "id")
    assert neardup.classes(renamed, id_col="id").where("id = 2").first()["class_id"] == 1


def test_equal_turns_come_in_the_order_of_their_texts(spark):
    rows = [(1, 0, "user", "<|x"), (1, 0, "user", "<]"), (1, 1, "assistant", "y")]
    got = chat.read_back(chat.format_examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    import hashlib

    said = sorted(["<|x", "<]"])
    assert got["turns_sha256"] == hashlib.sha256(f"user\n{said[0]}\nuser\n{said[1]}\nassistant\ny\n".encode()).hexdigest()
