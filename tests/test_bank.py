"""Bank statements: signs, chunks, every kind of row, and statements of four layouts written from orders."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from granary.plans import audit_job
from granary.queries import ORACLE, QUERIES, statement_files
from granary.sources import bank
from granary.sources import statements as st

START, END = date(2025, 12, 17), date(2026, 1, 16)
HEAD = "Details of your account activity\nDate Description Withdrawals ($) Deposits ($) Balance ($)\nOpening Balance 1,000.00\n"


def rows(body, start=START, end=END):
    return [(r["transaction_date"] and (r["transaction_date"].month, r["transaction_date"].day), r["description"], r["amount"], r["balance"]) for r in bank.parse_bank(HEAD + body, start, end)]


def test_ambiguous_signs_take_minus_first():
    assert bank.resolve_signs([10.0, 10.0], [0, 0], 0.0) == [-1, 1]
    assert bank.resolve_signs([10.0, 5.0], [1, 0], 5.0) == [1, -1]
    assert bank.resolve_signs([10.0, 5.0], [1, 1], 5.0) is None
    assert bank.resolve_signs([], [], 0.0) is None and bank.resolve_signs([1.0], [0, 0], 1.0) is None


@pytest.mark.parametrize(("text", "sign"), [
    ("Loan interest refund", -1), ("Online Banking transfer deposit", 0), ("Online transfer to deposit account", -1), ("CRA-REV payment", 1), ("Item returned NSF payment", 1), ("item returned", -1), ("Payroll", 1),
    ("e-Transfer received", 1), ("e-Transfer sent", -1), ("purchase refund", 1), ("anything", -1),
])
def test_wordings_decide_in_order(text, sign):
    assert bank.keyword_sign(text) == sign


def test_every_kind_of_row():
    got = rows(
        "18 Dec Partial monthly fee 4.00 996.00\n19 Dec Partial monthly fee 3.00\nLoan interest 3.00 990.00\nInterest charge 1.00 989.00\n20 Dec Bill Payment hydro 9.00 980.00\n"
        "Item returned NSF 20.00 1,000.00\nInsurance premium 50.00 950.00\n21 Dec A refund 10.00 B 20.00 C 5.00 935.00\n22 Dec e-Transfer received 1.00 e-Transfer received 2.00 900.00\n"
        "23 Dec thing 40.00 940.00\n24 Dec Online Transfer to Deposit 7.00 930.00\n25 Dec echo 6.00 6.00\n26 Dec Payroll 5.00\n"
    )
    assert got[:3] == [((12, 18), "Partial monthly fee", -4.0, 996.0), ((12, 19), "Partial monthly fee", -3.0, None), ((12, 19), "Loan interest 3.00 990.00 Interest charge", -1.0, 989.0)]
    assert [r[1:3] for r in got if r[0] == (12, 20)] == [("Bill Payment hydro", -9.0), ("Item returned NSF", 20.0), ("Insurance premium", -50.0)]
    assert [r[1:] for r in got if r[0] == (12, 21)] == [("A refund", 10.0, None), ("B", -20.0, None), ("C", -5.0, 935.0)]
    # no signs fit: one row of the whole change
    assert [r[2:] for r in got if r[0] == (12, 22)] == [(-35.0, 900.0)]
    assert [r[2:] for r in got if r[0] and r[0][1] in (23, 24, 25, 26)] == [(40.0, 940.0), (-7.0, 930.0), (-6.0, None), (5.0, None)]


def test_rows_that_share_a_balance():
    assert rows("18 Dec Online Banking transfer - 12 100.00\nInterac purchase 50.00 850.00\n") == [((12, 18), "Online Banking transfer - 12", -100.0, None), ((12, 18), "Interac purchase", -50.0, 850.0)]
    assert rows("18 Dec Online Banking loan payment 300.00\nMortgage payment 100.00 600.00\n")[1] == ((12, 18), "Mortgage payment", -100.0, 600.0)
    # only after online banking: others are rows of their own
    assert [r[2] for r in rows("18 Dec e-Transfer sent 10.00\nContactless purchase 5.00 985.00\n")] == [-10.0, -5.0]


def test_pages_without_dates_and_bad_days():
    got = rows("18 Dec a 1.00 999.00\n1 of 2\nDate Description\nATM withdrawal 9.00 990.00\n25 Dec b 1.00 989.00\nClosing Balance 1.00\nDate Description\nc 1.00 988.00\n")
    assert [r[0] for r in got] == [(12, 18), (12, 24), (12, 25), (12, 25)]
    assert rows("31 Feb x 1.00 999.00\n") == [(None, "x", -1.0, 999.0)]
    # without a period no year is made up
    assert rows("18 Dec a 1.00 999.00\n", None, None) == [(None, "a", -1.0, 999.0)]
    assert bank.parse_bank("no activity here", START, END) == [] and rows("") == []
    assert bank.day_of("Feb", "29", date(2023, 3, 1), date(2025, 2, 28)) == date(2024, 2, 29) and bank.day_of("feb", "29", None, date(2025, 12, 31)) == date(2024, 2, 29)


def test_references_leave_descriptions():
    assert bank.split_reference("PAYMENT  1234567890") == ("PAYMENT", "1234567890") and bank.split_reference("A 123456789") == ("A 123456789", "")
    got = bank.parse_bank(HEAD + "18 Dec Bill Payment 1234567890123 9.00 991.00\n", START, END)
    assert (got[0]["description"], got[0]["reference"], got[0]["posting_date"]) == ("Bill Payment", "1234567890123", None)
    line = "Date Description\n5 Jan Cash advance 1234567890 50.00 -850.00\n"
    assert [(r["description"], r["reference"], r["amount"], r["balance"]) for r in st.parse_credit_line(line, START, END)] == [("Cash advance", "1234567890", -50.0, -850.0)]


@pytest.mark.parametrize("name", ["parsed_bank_statements", "parsed_card_statements", "parsed_credit_lines", "parsed_tables", "audit_extraction", "audit_reconciliation", "audit_account_summary"])
def test_statements_written_from_orders_come_back(same, name):
    same(QUERIES[name], ORACLE[name])


def test_the_audit_job_writes_four_reports_and_counts(spark, tmp_path):
    files = statement_files(spark, "/root/testdata/sf0.001").drop("layout").where("name like '%-0010 %' or name like '%-0012 %'").select("name", "text")
    odd = spark.createDataFrame([("notes.txt", "x"), ("Chequing Statement-7777 2020-01-31.txt", None)], "name string, text string")
    n = files.count()
    assert n > 2
    counts = audit_job.audit_folder(spark, files.unionByName(odd), f"file://{tmp_path}")
    assert counts["files"] == n + 2 and counts["empty_files"] == 2 and counts["errors"] == 0 and counts["rows"] > n
    assert counts["reconciled"] == n and counts["not_reconciled"] == 2 and counts["failed"] == 0
    assert sorted(p.name for p in tmp_path.iterdir()) == ["account_month_coverage.csv", "account_summary.csv", "statement_extraction.csv", "statement_reconciliation.csv"]
    said = spark.read.option("header", "true").csv(f"file://{tmp_path}/statement_reconciliation.csv")
    assert {r["notes"] for r in said.where("extract_row_count = 0").collect()} == {"Unknown layout; totals not checked.", "No totals found in the statement."}
    # tax reversals, which statements count as withdrawals, are on the side that matches
    checked = QUERIES["audit_reconciliation"](spark, "/root/testdata/sf0.001")
    moved = QUERIES["parsed_bank_statements"](spark, "/root/testdata/sf0.001").where("description like 'CRA-REV%'").select(F.col("source_file").alias("filename")).distinct()
    assert moved.count() > 5 and moved.join(checked.where("reconcile_ok and parsed_out > 0"), "filename").count() == moved.count()


def test_a_file_that_cannot_be_read_is_one_row(spark, monkeypatch):
    rows_ = st.parse_statements(spark.createDataFrame([("Visa Statement-1 2020-01-31.txt", "STATEMENT FROM JAN 01, 2020 TO JAN 31, 2020\nJAN 99 JAN 99 SHOP\n$1.00\n" + " " * 60)], "name string, text string")).collect()
    assert [(r["transaction_date"], r["amount"], r["error"]) for r in rows_] == [(None, 1.0, None)]
