import hashlib
import random
import sys

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm import ann, chat, decontaminate, html_text, mixing, neardup, passages, quality, registry, shingling, toxicity, warc
from granary.llm.common import shared_path
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_agrees_with_sql(same, name):
    same(registry.QUERIES[name], registry.ORACLES[name])


def edge_docs(spark):
    a = prose(1, 300)
    b = a.split()
    b[100] = "zz"
    rows = [
        (1, a, "en", "s", 1), (2, a, "en", "s", 1), (3, " ".join(b), "en", None, 1), (4, prose(2, 200) + " " + " ".join(a.split()[:60]), None, "t", 1), (5, "", "en", "s", 0), (6, None, None, None, None),
        (7, "one two", "en", "t", 7), (8, "one two", "en", "t", 7), (None, a, "en", "s", 1), (9, prose(3, 80), "en", "u", 1), (9, prose(3, 80), "en", "u", 1),
    ]
    return spark.createDataFrame(rows, DOCS)


def test_mixing_hits_targets(spark):
    got = mixing.mix(edge_docs(spark)).collect()
    assert len(got) == 11
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by.setdefault((r["source"], r["target"]), []).append(r["taken"])
    assert all(abs(sum(v) - t) < 1 for (_, t), v in by.items())
    assert sum(t for _, t in by) == pytest.approx(1.5 * sum(r["size"] for r in got))
    assert mixing.mix(edge_docs(spark).limit(0)).count() == 0


def test_neardup_classes(spark):
    got = {(r["doc_id"]): r["class_id"] for r in neardup.classes(edge_docs(spark)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 7, 9: 9, None: None}
    kept = sorted((r["doc_id"] or 0) for r in neardup.keep_one(spark, edge_docs(spark), SF).collect())
    assert kept == [0, 1, 4, 5, 6, 7, 9]


def test_passages_are_found_and_cut(spark):
    docs = edge_docs(spark)
    spans = {(r["doc_id"], r["start"], r["stop"]) for r in passages.repeats(docs).collect()}
    assert {(2, 0, 300), (4, 200, 260)} <= spans
    assert not [s for s in spans if s[0] in (1, 5, 6, 7, 8, 9)]
    cut = {r["doc_id"]: r["text"] for r in passages.cut_repeats(spark, docs, SF).collect()}
    assert cut[4].split() == prose(2, 200).split() and cut[1] == prose(1, 300) and 2 not in cut and cut[5] == ""
    assert passages.repeats(docs.limit(0)).count() == 0


def test_leaks(spark):
    docs = edge_docs(spark)
    item = " ".join(prose(1, 300).split()[20:50])
    items = spark.createDataFrame([(1, item.upper()), (2, "too short"), (3, None), (4, prose(9, 30)), (5, "One, TWO"), (6, "two one")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, items).collect()}
    assert found == {(1, 1), (2, 1), (3, 1), (4, 1), (None, 1), (7, 5), (8, 5)}
    assert decontaminate.leaks(docs, items.limit(0)).count() == decontaminate.leaks(docs.limit(0), items).count() == 0


def test_leaks_in_many_passes(spark, monkeypatch):
    """Few hashes a pass: every size partition is dealt over several, with the same result."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = sorted(decontaminate.leaks(docs, items).collect())
    monkeypatch.setattr(decontaminate, "PROBES", 40)
    assert whole and sorted(decontaminate.leaks(docs, items).collect()) == whole


def test_toxicity_separates(spark):
    bad, good = [f"{prose(i, 30)} scumbag {prose(i + 900, 9)}" for i in range(40)], [prose(i + 100, 40) for i in range(80)]
    model = toxicity.fit((t, y) for t, y in [(t, 1) for t in bad[:30]] + [(t, 0) for t in good[:60]])
    assert (model.log_odds(bad[30:]) > 0).all() and (model.log_odds(good[60:]) < 0).all()
    assert toxicity.fit(iter([])).log_odds(["x", None, ""]).shape == (3,)
    scored = toxicity.score(edge_docs(spark), model, keep=["doc_id"]).collect()
    assert len(scored) == 11 and all(0 <= r["tox_score"] <= 1 for r in scored)


def test_toxicity_held_out(spark):
    got = toxicity.op9_toxicity(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = got.where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    assert sum(r[0] == r[1] for r in rows) / len(rows) > 0.9


def test_quality(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 0), (7, 0, 0), (5, 0, 0), (None, 1, 1), (9, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.rate_documents(docs, labels).collect()
    assert len(got) == 11 and all(0 <= r["quality"] <= 1 for r in got)
    assert quality.rate_documents(docs.limit(0), labels).count() == 0


def test_warc_rejects_magic_in_payloads(spark):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    pages = [(1, "http://a b", "x" * 150), (2, None, "x" * 150), (3, "u", None), (4, "u", ""), (5, "u", f"<p>{fake}</p>{fake}é"), (6, "u", "tiny"), (7, "u", "tiny"), (None, "u", "y" * 120)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    path = shared_path(spark, "warc-test")
    warc.write_warc(df, path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    try:
        got = {r["page_id"]: r for r in warc.read_warc(spark, path).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert set(got) == {1, 2, 3, 4, 5, 6, 7, None}
    assert got[2]["record_type"] == "revisit" and got[2]["refers_to"] == 1 and got[7]["record_type"] == "response"
    for i, _, html in pages:
        data = (html or "").encode()
        assert got[i]["payload_digest"] == hashlib.sha256(data).hexdigest() and got[i]["payload_bytes"] == len(data)
        if got[i]["record_type"] == "response":
            assert bytes(got[i]["payload"]) == data


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    x[200:] = x[200]
    rows = [(i, [float(v) for v in x[i]]) for i in range(400)] + [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] * 8), (1060, [1.0, None]), (None, [1.0] * 8)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    y = x.astype(float)
    hits = 0
    for q in range(0, 400, 20):
        s = (y[q] * y).sum(1)
        s[q] = -np.inf
        want = list(np.lexsort((np.arange(400), -s))[:20])
        mine = [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])]
        assert len(mine) == 20
        hits += len(set(mine) & set(want))
    assert len(got) == 400 and hits / 400 >= 0.9


def test_nearest_recall_on_the_table(spark):
    """Recall against brute force over all rows, and the number of leaves visited."""
    got = ann.op6_nearest(spark, "/root/testdata/sf0.01").collect()
    rows = ann.usable(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")).collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    hits = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[ids == ids[i]] = -np.inf
        want = ids[np.lexsort((ids, -s))[:20]]
        hits += len(set(want.tolist()) & set(found[int(ids[i])]))
        total += 20
    assert total and hits / total >= 0.9


def test_nearest_repeats_and_parts(spark, monkeypatch):
    """Few rows a block and queries a part, repeated rows, and a column of the operator's own name."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 6))
    rows = [(i, [float(v) for v in x[i]], "l") for i in range(200)] * 2
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, leaf string").withColumn("av_vec", F.lit(1))
    monkeypatch.setattr(ann, "BLOCK", 7)
    monkeypatch.setattr(ann, "QUERIES", 3)
    monkeypatch.setattr(ann, "HELD", 100)
    got = ann.search(df, recall=1.0).collect()
    for q in range(0, 200, 20):
        s = [(-float(x[q] @ x[j]), j) for j in range(200) if j != q for _ in range(2)]
        mine = [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])]
        assert len(mine) == 20 and len(set(mine) & {j for _, j in sorted(s)[:20]}) >= 9
    assert ann.search(df.limit(0)).count() == 0


def test_main_text():
    w = html_text.DEFAULT_WEIGHTS
    page = "<html><head><title>t</title></head><body><div class='cookie-notice'>We use cookies on this site for you</div><ul class=menu><li><a href=1>Home</a></ul><div class=story><h2>A title &amp; more</h2><p>Some words that make   a paragraph of text<br>and more.</p><script>var a = '<p>no</p>';</script><form>Your name please</form><p>The end.</p></div><div id=comments><p>Nice article, I liked reading it very much indeed</p></div><footer>Imprint</footer></body></html>"
    assert html_text.main_text(page, w) == "A title & more Some words that make a paragraph of text and more. The end."
    assert html_text.main_text(None, w) == html_text.main_text("", w) == html_text.main_text("<p></p>", w) == ""


def test_main_text_is_the_marked_article(spark):
    import re

    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r["page_id"]: r["text"] for r in html_text.op7_html(spark, SF).collect()}
    for r in rows:
        article = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = re.sub(r"</?(p|h1|br)[^>]*>", " ", article)
        import html

        assert got[r["page_id"]] == " ".join(html.unescape(re.sub("<[^>]+>", "", blocks)).split())


@settings(max_examples=20, deadline=None)
@given(texts=st.lists(st.text(alphabet="ab <>|[]/\\s INST_SY", max_size=30), min_size=1, max_size=20))
def test_chat_escape_round_trip(texts):
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect()
    assert [r["u"] for r in got] == texts
    assert not [r["e"] for r in got if "</s>" in r["e"] or "[INST]" in r["e"] or "<|" in r["e"]]


def test_chat_edges(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, None, None), (2, 0, "assistant", "<|end|>x"), (None, 0, "user", "q"), (2, 1, "assistant", "y"), (2, 2, "user", "tail")]
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert got[1]["n_turns"] == 2 and got[1]["loss_chars"] == 0 and got[2]["loss_chars"] == len("<|end|>xy") and got[2]["n_turns"] == 3
    assert got[2]["loss_sha256"] == hashlib.sha256(b"<|end|>xy").hexdigest()


@settings(max_examples=60, deadline=None)
@given(values=st.lists(st.integers(0, 9), max_size=60), length=st.integers(2, 6))
def test_compact_windows_cover_all_subsequences(values, length):
    h = np.array(values, np.uint64) << np.uint64(40)
    c, left, right, _ = passages.compact_windows(h, np.array([0, len(h)]), length)
    for i in range(len(h)):
        for j in range(i + length - 1, len(h)):
            low = i + int(np.argmin(h[i : j + 1]))
            assert any(x == low and a <= i and b >= j for x, a, b in zip(c, left, right))


def test_word_hashes_are_the_words():
    texts = ["Ab, cd! É1", None, "", "ab cd ab"]
    h, at = shingling.word_hashes(texts)
    assert list(np.diff(at)) == [3, 0, 0, 3]
    assert h[0] == h[3] == h[5] and h[1] == h[4]


def test_pipeline(spark):
    sys.path.insert(0, "/root/repo")
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = corpus_pipeline.run(spark, SF)
    ids = {r["doc_id"] for r in got.collect()}
    assert ids < {r["doc_id"] for r in docs.select("doc_id").collect()}
    leaking = {r["doc_id"] for r in registry.QUERIES["op5_decontaminate"](spark, SF).collect()}
    classes = neardup.classes(docs).where("doc_id <> class_id").collect()
    assert len(ids) > 0.6 * docs.count() and classes and leaking is not None
