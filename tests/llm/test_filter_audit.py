"""Filter audit: against a plain loop over all orders, with collisions, and against SQL."""

from itertools import permutations

import pytest
from granary.llm import filter_audit as fa
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"
LONG = "a b" * 90_000


def plain(docs, labels):
    least = {}
    for i, _, text in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    rows = []
    for i, source, text in docs:
        text = text or ""
        words = "".join(" " if c in WHITE else c for c in text).split(" ")
        words = [w for w in words if w]
        fails = {x for x, f in zip("ABCDE", (
            len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
            any(c in "#$%&*|" for c in text), i is not None and least[text] < i)) if f}
        own = [x for x in labels if x[0] == i and i is not None]
        rows.append((source or "", fails, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = {}
    for part in {r[0] for r in rows}:
        here = [r for r in rows if r[0] == part]
        sums = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = here
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                sums[x] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(x in r[1] for r in here) - len(gone), sum(r[1] == {x} for r in here), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for order in permutations("ABCDE"):
            for step, x in enumerate(order, 1):
                out[part, "".join(order), step].append(sums[x])
    return out


def run(spark, docs, labels, bits=64):
    blank = F.lit("")
    df = spark.createDataFrame([(*d, "own", 5) for d in docs], "doc_id long, source string, text string, mask string, rows int")
    df = df.select(F.col("doc_id").alias("id"), F.coalesce("source", blank).alias("part"), F.coalesce("text", blank).alias("text"))
    got = fa.audit(fa.masks(df, bits), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    return {tuple(r[:3]): list(r[3:]) for r in got.collect()}


def crowd():
    base = " ".join(f"word{i}" for i in range(60))
    texts = [base, base, base + "!", base.upper(), "A#", "", None, "x " * 70, LONG + "b", LONG + "c", LONG + "b", base + " " * 10, "é" * 64, "é" * 64, "é" * 63 + "e", "q" * 512, "q" * 511 + "r", "q" * 512, "q" * 513]
    docs = [(i, [None, "", "s", "t"][i % 4], t) for i, t in enumerate(texts)]
    docs += [(200 + i, "copies", base) for i in range(40)] + [(5, "s", ""), (0, None, base), (None, "s", base), (None, "s", base), (900, "t", None)]
    labels = [(0, 1, 0), (0, 0, 1), (4, 1, 1), (205, None, 1), (None, 1, 1), (7777, 1, 1), (8, 1, None)]
    return docs, labels


@pytest.mark.parametrize("bits", [64, 1, 3])
def test_agrees_with_a_loop_over_all_orders_also_where_hashes_collide(spark, bits):
    docs, labels = crowd()
    assert run(spark, docs, labels, bits) == plain(docs, labels)


def test_an_empty_table(spark):
    assert run(spark, [], [(1, 1, 1)]) == {}


def test_no_block_is_left_out(spark):
    df = spark.createDataFrame([("a" * n + "é" * (n > 0),) for n in (0, 1, 62, 63, 64, 510, 511, 512, 4095, 4096, 32_767)], "text string")
    for n, blocks in df.select(F.char_length("text"), F.size(fa.block_hashes(F.col("text")))).collect():
        assert 64 * 8 ** (blocks - 1) >= n
    # texts that differ in their last letter only never share a class
    last = spark.createDataFrame([("a" * n + x,) for n in (0, 62, 63, 511, 4095, 32_767) for x in "bc"], "text string")
    assert last.select(fa.block_hashes(F.col("text")).alias("h")).distinct().count() == 12


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_the_query_agrees_with_its_sql(spark, sf):
    import duckdb
    from tests.conftest import rows_of

    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, df = con.execute(fa.ORACLE), fa.op12_filter_audit(spark, sf)
    assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in got.description], got.fetchall())
