import random

from granary.llm import decontaminate, neardup, passages

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))


def test_leaks_are_decided_by_row(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 200").first()["text"]
    rows = [(None, item), (None, prose(1, 60)), (None, None), (7, item), (7, prose(2, 60)), (8, prose(3, 60))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    got = decontaminate.filter_leaks(spark, docs, SF).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got) == sorted((i or 0, t or "") for i, t in rows if t != item)


def test_near_copies_are_decided_by_row(spark):
    a, b, c = prose(4, 200), prose(5, 200), prose(6, 200)
    rows = [(1, a), (1, b), (1, b), (2, a), (3, b), (None, c), (None, c), (None, prose(7, 200)), (4, c), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in neardup.keep_one(spark, docs, SF).collect())
    assert got == sorted([(1, a), (1, b), (0, c), (4, c), (0, prose(7, 200)), (0, "")])


def test_passages_are_cut_by_row(spark):
    a, b, c = prose(8, 100), prose(9, 200), prose(10, 200)
    rows = [(1, a), (2, a + " " + c), (2, b), (None, prose(11, 60) + " " + a), (None, prose(12, 70))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    got = sorted((r["doc_id"] or 0, r["text"].strip()) for r in passages.cut_repeats(spark, docs, SF).collect())
    assert got == sorted([(1, a), (2, c), (2, b), (0, prose(11, 60)), (0, prose(12, 70))])
