"""Files of statements: listed in two roots, chosen by name, and only the chosen ones read."""

import pytest
from pyspark.sql import functions as F

from granary.queries import ORACLE, QUERIES
from granary.sources import files as fi
from granary.sources import statements as s

CARD = "STATEMENT FROM DEC 09, 2025 TO JAN 08, 2026\nSome Card 1111 - PRIMARY\nDEC 10 DEC 11 {shop}\n123456789012\n$12.34\n"


@pytest.mark.parametrize("name", ["chosen_files", "chosen_files_audit"])
def test_queries_agree_with_sql(same, name):
    same(QUERIES[name], ORACLE[name])


@pytest.fixture
def roots(tmp_path):
    put = {
        "drop/Visa Statement-1111 2026-01-08-1.md": CARD.format(shop="FROM DROP"),
        "uploads/Visa Statement-1111 2026-01-08.pdf": CARD.format(shop="FROM UPLOADS"),
        "uploads/Visa Statement-2222 2026-01-08-2-1.txt": CARD.format(shop="TWO COPIES"),
        "uploads/Visa Statement-2222 2026-01-08-10.txt": CARD.format(shop="ONE COPY"),
        "uploads/Visa%20Statement-3333%202026-01-08.txt": CARD.format(shop="ENCODED"),
        "uploads/Visa Statement-4444 2026-01-08.txt": b"\xff\xfe broken",
        "uploads/Visa Statement-5555 2026-01-08.PDF": b"%PDF-1.4 no pages",
        "uploads/notes.csv": "a,b",
        "uploads/deeper/Visa Statement-6666 2026-01-08.txt": CARD.format(shop="TOO DEEP"),
        "uploads/k=v/Visa Statement-7777 2026-01-08.txt": CARD.format(shop="TOO DEEP"),
    }
    for name, body in put.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body if isinstance(body, bytes) else body.encode())
    return [f"file://{tmp_path}/{r}" for r in ("drop", "uploads", "absent")]


def test_listing_reads_no_contents_and_no_subfolders(spark, roots):
    listed = fi.list_statements(spark, *roots)
    assert "content:binary" not in listed._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["file"], r["ext"], r["drop"]) for r in listed.collect()) == [
        ("Visa Statement-1111 2026-01-08-1.md", "md", True), ("Visa Statement-1111 2026-01-08.pdf", "pdf", False), ("Visa Statement-2222 2026-01-08-10.txt", "txt", False),
        ("Visa Statement-2222 2026-01-08-2-1.txt", "txt", False), ("Visa Statement-4444 2026-01-08.txt", "txt", False), ("Visa Statement-5555 2026-01-08.PDF", "pdf", False),
        ("Visa%20Statement-3333%202026-01-08.txt", "txt", False),
    ]


def test_chosen_files_are_read_and_broken_ones_are_rows(spark, roots):
    rows = {r["statement_id"]: r for r in fi.statements_in(spark, *roots).collect()}
    assert len(rows) == 5
    assert sorted(r["description"] for r in rows.values() if r["error"] is None) == ["ENCODED", "FROM DROP", "ONE COPY"]
    assert "UnicodeDecodeError" in rows["Visa Statement-4444 2026-01-08"]["error"] and rows["Visa Statement-5555 2026-01-08"]["error"]


def test_folders_count_only_where_asked(spark, roots):
    listed = fi.list_statements(spark, *roots)
    first = lambda **k: {r["file"] for r in s.unique_statements(listed, **k).collect() if "1111" in r["file"] or "2222" in r["file"]}
    assert first() == {"Visa Statement-1111 2026-01-08-1.md", "Visa Statement-2222 2026-01-08-10.txt"}
    assert first(folders=False) == {"Visa Statement-1111 2026-01-08.pdf", "Visa Statement-2222 2026-01-08-10.txt"}


def test_no_roots_and_empty_ones(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    assert fi.list_statements(spark).count() == 0
    assert fi.statements_in(spark, f"file://{tmp_path}/empty", f"file://{tmp_path}/none").count() == 0


def test_logical_stems(spark):
    got = spark.createDataFrame([("Credit Line  Statement-1111   2026-01-16-123-4 ",), ("chequing statement-1111 2026-01-16",), ("other 2026-01-16-1",)], "x string").select(s.logical_stem(F.col("x"))).collect()
    assert [r[0] for r in got] == ["Credit Line  Statement-1111 2026-01-16", "chequing statement-1111 2026-01-16", "other 2026-01-16-1"]


def test_expectations_are_kept_and_held_against_a_listing(spark, tmp_path):
    from granary.sources.settings import Settings, write_text

    kept = Settings(spark, f"file://{tmp_path}/settings")
    assert kept.load_expectations() == ({"chequing": 4, "visa": 1, "mastercard": 1}, {})
    write_text(spark, f"file://{tmp_path}/settings/expectations-000001.json", "[broken")
    assert kept.load_expectations() == ({"chequing": 4, "visa": 1, "mastercard": 1}, {})
    assert kept.save_expectations({"chequing": None, "visa": 2}, {"mastercard": ["3333"]}) == kept.load_expectations() == ({"visa": 2, "mastercard": 1}, {"mastercard": ["3333"]})
    names = ["Visa Statement-1111 2026-01-08", "Visa Statement-1111 2026-01-08-1", "Visa Statement-2222 2026-01-09", "MasterCard Statement-3333 2026-01-10", "MasterCard Statement-4444 2026-02-10", "notes"]
    listed = spark.createDataFrame([(n, "pdf", True) for n in names], "stem string, ext string, drop boolean")
    got = {r["month"]: r for r in fi.statement_coverage(listed, *kept.load_expectations()).collect()}
    assert got["2026-01"]["ok"] and got["2026-01"]["pdf_count"] == 3 and got["2026-01"]["visa"] == ["1111", "2222"]
    assert not got["2026-02"]["ok"] and "visa: expected 2 accounts, found 0" in got["2026-02"]["issues"] and "mastercard: expected 3333, found 4444" in got["2026-02"]["issues"]


def test_the_dashboard_shows_coverage_and_totals(spark):
    from granary.plans import audit_job, dashboard
    from granary.queries import facts, statement_files

    sf = "/root/testdata/sf0.001"
    texts = statement_files(spark, sf).where("name like '%-000%'").select("name", "text")
    listed = texts.select("name").withColumns(fi.named(F.regexp_replace("name", r"(-12-31) .*(\.)", "$1$2"))).withColumn("drop", F.lit(True))
    reconciled = audit_job.run_audit(texts)[0]["statement_reconciliation"]
    out = dashboard.dashboard(facts(spark, sf), coverage=fi.statement_coverage(listed), reconciled=reconciled)
    months = [r["month"] for r in out["statement_coverage"].collect()]
    assert months and months == sorted(set(months)) and all(m.endswith("-12") for m in months)
    check = out["statement_totals_check"].first()
    assert check["file_count"] == texts.count() and 0 < check["ok_count"] <= check["file_count"]
    assert out["internal_review_matched"].collect() == out["matched_transfers"].collect()[:35]
    assert out["internal_review_unmatched"].collect() == out["unmatched_internal"].collect() and out["internal_review_stats"].count() == 1
