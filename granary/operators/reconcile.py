"""Statement totals held against the sums of parsed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.fixed import RECONCILE_CENTS
from granary.functions.text import strict_amount

# --- fixed values: how statements word their totals ---
DEPOSITS = r"(?i)total\s+deposits\s+(?:into\s+your\s+account\s*)?\+?\s*([\d,]+\.\d{2})"
WITHDRAWALS = r"(?i)total\s+withdrawals\s+(?:from\s+your\s+account\s*)?-?\s*([\d,]+\.\d{2})"
PURCHASES = r"(?i)Purchases\s*&\s*debits\s*\$?\s*([\d,]+\.\d{2})"
PAYMENTS = r"(?i)Payments\s*&\s*credits\s*-\s*\$?\s*([\d,]+\.\d{2})"
LINE_TOTAL = r"(?i)Sum\s+of\s+{}\s+including\s+adjustments\s+on\s+your\s+account\s*\$?\s*([\d,\s\.]+)"
LINE_LOOSE = r"(?is)Sum\s+of\s+{}\s+including\s+adjustments.{{0,220}}?\$\s*([\d,\s\.]+)"
LINE_HEAD = 12_000


def statement_kind(file_name: Column, text: Column) -> Column:
    """By the file's name first, then by what the text holds."""
    n, u = F.lower(file_name), F.upper(text)
    return (
        F.when(n.contains("credit line"), "credit_line").when(n.contains("chequing"), "bank_account").when(n.rlike("visa|mastercard"), "credit_card")
        .when(u.contains("POSTING") & u.contains("ACTIVITY DESCRIPTION") & u.contains("TRANSACTION"), "credit_card")
        .when(u.contains("DETAILS OF YOUR ACCOUNT ACTIVITY") & u.contains("WITHDRAWALS"), "bank_account")
        .when(F.replace(u, F.lit("\n"), F.lit(" ")).contains("SUM OF PAYMENTS INCLUDING ADJUSTMENTS ON YOUR ACCOUNT"), "credit_line").otherwise("unknown")
    )


def stated_totals(kind: Column, text: Column) -> tuple[Column, Column]:
    """What comes in and goes out by the statement's own summary; null where it has none."""
    first = lambda blob, pattern: strict_amount(F.regexp_extract(blob, pattern, 1))
    flat = F.regexp_replace(F.substring(text, 1, LINE_HEAD), r"\s+", " ")
    line = lambda what: F.coalesce(first(flat, LINE_TOTAL.format(what)), first(flat, LINE_LOOSE.format(what)))
    into = F.when(kind == "bank_account", first(text, DEPOSITS)).when(kind == "credit_card", first(text, PURCHASES)).when(kind == "credit_line", line("payments"))
    out = F.when(kind == "bank_account", first(text, WITHDRAWALS)).when(kind == "credit_card", first(text, PAYMENTS)).when(kind == "credit_line", line("withdrawals"))
    return into, out


def reconcile(statements: DataFrame, rows: DataFrame, key: str = "statement_id") -> DataFrame:
    """statements (key, kind, statement_in, statement_out) against rows (key, description, amount): sums, differences, ok and notes.

    On bank statements tax reversals may be listed as deposits though the summary counts them as withdrawals: they
    change sides where that makes both sides match.
    """
    return checked(with_sums(statements, rows, key), key)


def with_sums(statements: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """statements with the columns of row_sums(), zeros where a statement has no rows."""
    zero = F.lit(0).cast("decimal(18,2)")
    got = statements.join(row_sums(rows, key), key, "left")
    return got.withColumns({"row_count": F.coalesce("row_count", F.lit(0)), "pin": F.coalesce("pin", zero), "pout": F.coalesce("pout", zero), "moved": F.coalesce("moved", zero)})


def row_sums(rows: DataFrame, key: str) -> DataFrame:
    """Of each statement: row_count, pin and pout (what its rows put in and take out), moved (tax reversals among pin)."""
    a = F.col("amount").cast("decimal(18,2)")
    zero = F.lit(0).cast("decimal(18,2)")
    reversal = (a > 0) & F.lower("description").contains("cra-rev")
    return rows.groupBy(key).agg(
        F.count("*").alias("row_count"), F.coalesce(F.sum(F.when(a > 0, a)), zero).alias("pin"), F.coalesce(F.sum(F.when(a < 0, -a)), zero).alias("pout"), F.coalesce(F.sum(F.when(reversal, a)), zero).alias("moved"),
    )


def checked(got: DataFrame, *keys: str) -> DataFrame:
    """reconcile() of statements that have the columns of row_sums() already; keys: all columns that stay."""
    want_in, want_out = F.col("statement_in").cast("decimal(18,2)"), F.col("statement_out").cast("decimal(18,2)")
    near = lambda x, y: F.abs(x - y) <= F.lit(RECONCILE_CENTS).cast("decimal(4,2)")
    shifted = (F.col("kind") == "bank_account") & (F.col("moved") > 0) & near(F.col("pin") - F.col("moved"), want_in) & near(F.col("pout") + F.col("moved"), want_out)
    shifted = F.coalesce(shifted, F.lit(False))
    got = got.withColumns({"pin": F.when(shifted, F.col("pin") - F.col("moved")).otherwise(F.col("pin")), "pout": F.when(shifted, F.col("pout") + F.col("moved")).otherwise(F.col("pout"))})
    ok = F.coalesce(near(F.col("pin"), want_in) & near(F.col("pout"), want_out) & (F.col("kind") != "unknown") & ((F.col("kind") != "credit_line") | (F.col("row_count") > 0)), F.lit(False))
    notes = (
        F.when(F.col("kind") == "unknown", "Unknown layout; totals not checked.").when(want_in.isNull() & want_out.isNull(), "No totals found in the statement.")
        .when(want_in.isNull() | want_out.isNull(), "Only one total found in the statement.").when(ok, "Row sums match the statement.").otherwise("Row sums differ from the statement.")
    )
    d = lambda c: c.cast("double")
    return got.select(
        *keys, "kind", "row_count", d(want_in).alias("statement_in"), d(want_out).alias("statement_out"), d(F.col("pin")).alias("parsed_in"), d(F.col("pout")).alias("parsed_out"),
        d(F.col("pin") - want_in).alias("diff_in"), d(F.col("pout") - want_out).alias("diff_out"), ok.alias("ok"), notes.alias("notes"),
    )


def totals_report(reconciled: DataFrame) -> DataFrame:
    return reconciled.agg(F.count_if("ok").alias("ok_count"), F.count("*").alias("file_count"))
