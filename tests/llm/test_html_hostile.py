import time

from granary.llm import html_text

W = html_text.DEFAULT_WEIGHTS


def test_time_is_linear_in_nesting_and_open_quotes():
    for page in ("<div>word " * 40_000, '<a href="x ' * 20_001 + ">", '<a ">" ' * 20_000, "</b>" * 50_000, "<b>" * 40_000 + "</i>" * 40_000, "<div>" * 20_000 + "<p>x" * 20_000):
        start = time.time()
        html_text.main_text(page, W)
        assert time.time() - start < 20


def test_a_long_article_comes_out_whole():
    page = "<html><body><nav><a href=1>Home</a></nav><div>" + "<p>some words that stand here</p>" * 20_000 + "</div><footer>imprint</footer></body></html>"
    assert html_text.main_text(page, W) == " ".join(["some words that stand here"] * 20_000)


def test_rows_and_names(spark):
    rows = [(1, "u", "<p>one two three</p>", "x"), (1, "u", "<p>one two three</p>", "y"), (None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars string").withColumnRenamed("n_chars", "text")
    got = sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in html_text.extract(pages).collect())
    assert got == [(0, "", 0), (1, "one two three", 13), (1, "one two three", 13)]
    assert html_text.extract(pages.limit(0)).count() == 0
