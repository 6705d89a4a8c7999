from datetime import date

from pyspark.sql import functions as F

from granary.plans.rebuild import rebuild
from granary.sources import bank
from granary.sources import statements as s

CARD = """STATEMENT FROM DEC 09, 2025 TO JAN 08, 2026
Card 1234 - PRIMARY
DEC 10 DEC 11 SHOPPERS DRUG MART
123456789012
$12.34
JAN 02 JAN 03 PAYMENT - THANK YOU
-$50.00
"""
BANK = """From December 17, 2025 to January 16, 2026
Details of your account activity
Date Description Withdrawals ($) Deposits ($) Balance ($)
Opening Balance 1,000.00
18 Dec Interac purchase 12.34 987.66
2 Jan Payroll deposit 100.00
Something odd 20.00 1,067.66
Closing Balance 1,067.66
"""
TABLE = """<table><tr><th>Transaction Date</th><th>Posting Date</th><th>Activity Description</th><th>Amount</th></tr>
<tr><td>DEC 10</td><td>DEC 11</td><td>A &amp; B</td><td>$5.00</td></tr><tr><td></td><td></td><td>1234567890</td><td></td></tr></table>"""


def test_parsers_and_rebuild(spark):
    files = [("Visa Statement-2222 2026-01-08.txt", CARD), ("Chequing Statement-1111 2026-01-16.txt", BANK), ("Visa%20Statement-2222%202025-12-31.md", TABLE), ("notes.txt", "x"), ("none.txt", None)]
    rows = s.parse_statements(spark.createDataFrame(files, "name string, text string")).collect()
    got = {(r["source_file"][:4], r["description"]): (r["transaction_date"], r["amount"], r["reference"], r["statement_type"]) for r in rows}
    assert got[("Visa", "SHOPPERS DRUG MART")] == (date(2025, 12, 10), 12.34, "123456789012", "credit_card")
    assert got[("Visa", "PAYMENT - THANK YOU")][:2] == (date(2026, 1, 2), -50.0)
    assert got[("Visa", "A & B")] == (date(2025, 12, 10), 5.0, "1234567890", "credit_card")
    assert [got[("Cheq", d)][1] for d in ("Interac purchase", "Payroll deposit", "Something odd")] == [-12.34, 100.0, -20.0]
    assert not [r for r in rows if r["error"]]
    raw = s.parse_statements(spark.createDataFrame(files, "name string, text string")).withColumn("ingest_pos", F.xxhash64("source_file", "line_pos"))
    facts = {r["description"]: r for r in rebuild(raw).collect()}
    assert facts["SHOPPERS DRUG MART"]["category"] == "Health & Pharmacy" and facts["PAYMENT - THANK YOU"]["is_internal"]
    assert facts["Payroll deposit"]["category"] == "Salary & EI" and float(facts["Interac purchase"]["expense_amount"]) == 12.34


def test_sign_search():
    assert bank.resolve_signs([10.0, 5.0], [0, 0], -5.0) == [-1, 1]
    assert bank.resolve_signs([10.0, 5.0], [1, 0], -5.0) is None
    assert bank.resolve_signs([1.0] * 9, [0] * 9, 9.0) is None


def test_files_and_names(spark):
    files = [("Chequing Statement-1111 2026-01-16", "pdf", False), ("Chequing Statement-1111 2026-01-16-1", "pdf", True), ("Chequing Statement-1111 2026-01-16-2-1", "pdf", True), ("Chequing Statement-1111 2026-01-16-1", "md", True), ("notes", "pdf", True)]
    df = spark.createDataFrame(files, "stem string, ext string, drop boolean")
    assert sorted((r["stem"], r["ext"]) for r in s.unique_statements(df).collect()) == [("Chequing Statement-1111 2026-01-16-1", "pdf"), ("notes", "pdf")]
    got = df.select(*[c.alias(n) for n, c in s.statement_meta(F.col("stem")).items()]).collect()
    assert got[0]["account_key"] == "chequing-1111" and got[0]["statement_month"] == "2026-01" and got[4]["account_key"] == "unknown"


def test_owners_roles_and_undated_rows(spark):
    from granary.sources import statements as st

    card = "JANE ANN DOE\nSTATEMENT FROM DEC 09, 2025 TO JAN 08, 2026\nJOHN DOE\nCard 1111 2222 - CO-APPLICANT\nDEC 10 DEC 11 SHOP NAME\n123456789012\n$12.34\n"
    bank = (
        "MARY MAJOR\nFrom December 17, 2025 to January 16, 2026\nDetails of your account activity\nDate Description Withdrawals ($) Deposits ($) Balance ($)\nOpening Balance 1,000.00\n"
        "18 Dec Interac purchase 12.34 987.66\n1 of 3\nDate Description Withdrawals ($) Deposits ($) Balance ($)\nATM withdrawal 10.00 977.66\n25 Dec ATM withdrawal 7.66 970.00\n"
        "2 of 3\nDate Description Withdrawals ($) Deposits ($) Balance ($)\nMonthly fee 1.00 969.00\nClosing balance 969.00\n"
    )
    table = "JANE DOE\n1234 - PRIMARY\n<table><tr><td>Transaction Date</td><td>Posting Date</td><td>Activity Description</td><td>Amount</td></tr><tr><td>DEC 12</td><td>DEC 13</td><td>SHOP</td><td>$1.00</td></tr></table>"
    files = spark.createDataFrame([("Visa Statement-2222 2026-01-08.txt", card), ("Chequing Statement-1111 2026-01-16.txt", bank), ("notes.md", table)], "name string, text string")
    rows = st.ingest_order(st.parse_statements(files)).orderBy("ingest_pos").collect()
    assert [str(r["error"]) for r in rows] == ["None"] * len(rows)
    by = {}
    for r in rows:
        by.setdefault(r["source_file"][:4], []).append(r)
    assert [(r["owner"], r["role"], r["household"], r["account_last4"]) for r in by["Visa"]] == [("John Doe", "Co-Applicant", "Jane Ann Doe & John Doe", "2222")]
    assert [str(r["transaction_date"]) for r in by["Cheq"]] == ["2025-12-18", "2025-12-24", "2025-12-25", "2025-12-25"]
    assert {(r["owner"], r["role"]) for r in by["Cheq"]} == {("Mary Major", "Holder")}
    assert [(r["owner"], r["role"], r["account_last4"]) for r in by["note"]] == [("Jane Doe", "Primary", "1234")]
    assert [r["source_file"] for r in rows] == sorted(r["source_file"] for r in rows)


def test_credit_line_rows(spark):
    from datetime import date

    from granary.sources import statements as st

    text = (
        "Details of your account activity\nDate Description Payments ($) Withdrawals ($) Balance owing ($)\nOpening balance -1,000.00\n"
        "3 Jan WWW PMT - 4412 (200.00)\nPrincipal 200.00 -800.00\n5 Jan WWW TFR MIN 50.00 -850.00\n7 Jan Interest 4.10 -854.10\n"
        "Date Description Payments ($) Withdrawals ($) Balance owing ($)\nCash advance 10.00 -864.10\n12 Jan Interest payment 4.10 -860.00\nClosing balance -860.00\n"
    )
    kind, rows = st.parse_statement(text, date(2026, 1, 1), date(2026, 1, 31))
    assert kind == "credit_line"
    assert [(r["transaction_date"].day, r["description"], r["amount"]) for r in rows] == [
        (3, "WWW PMT - 4412 (200.00) Principal", 200.0), (5, "WWW TFR MIN", -50.0), (7, "Interest", -4.1), (11, "Cash advance", -10.0), (12, "Interest payment", 4.1),
    ]
