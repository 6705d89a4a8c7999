"""The audit's datasets, and the datasets of audit and statistics as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def audit(extracted: DataFrame, checked: DataFrame) -> DataFrame:
    """Each extracted file with what its reconciliation says; one that was not checked counts as not reconciled.

    extracted: filename, account_key, account_kind, account_last4, statement_month, extract_status, row_count.
    checked: filename, kind, ok, notes, one row for each file at most.
    """
    c = checked.select(F.col("filename").alias("c_file"), F.col("kind").alias("reconcile_kind"), F.col("ok").alias("c_ok"), F.col("notes").alias("c_notes"))
    got = extracted.join(c, F.col("filename") == F.col("c_file"), "left")
    return got.withColumns({"reconcile_ok": F.coalesce("c_ok", F.lit(False)), "notes": F.coalesce("c_notes", F.lit("")), "reconcile_kind": F.coalesce("reconcile_kind", F.lit("unknown"))}).drop("c_file", "c_ok", "c_notes")


def audit_counts(report: DataFrame) -> DataFrame:
    """How many files were extracted, failed, reconciled and not."""
    done = F.col("extract_status") == "ok"
    return report.agg(
        F.count("*").alias("files"), F.count_if(done).alias("extracted"), F.count_if(~done).alias("failed"), F.count_if(F.col("reconcile_ok")).alias("reconciled"), F.count_if(done & ~F.col("reconcile_ok")).alias("not_reconciled")
    )


def statement_rows(rows: DataFrame, report: DataFrame) -> DataFrame:
    """Rows (source_statement and a transaction's columns) with the account and month of their file; rows of no reported file go."""
    return rows.join(report.select(F.col("filename").alias("source_statement"), "account_key", "account_kind", "account_last4", "statement_month"), "source_statement")


def write_reports(datasets: dict[str, DataFrame], folder: str) -> None:
    """Each dataset as a folder of CSV files with a header, written by all tasks that have rows."""
    for name, df in datasets.items():
        df.write.mode("overwrite").option("header", "true").csv(f"{folder}/{name}.csv")


def read_report(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").csv(f"{folder}/{name}.csv")


def write_statements(rows: DataFrame, folder: str, by: str = "statement_id") -> None:
    """The rows of each statement in a folder of its own, named safely."""
    safe = F.substring(F.regexp_replace(F.col(by), r'[<>:"/\\|?*]', "_"), 1, 180)
    rows.withColumn("statement", safe).repartition("statement").write.mode("overwrite").partitionBy("statement").option("header", "true").csv(folder)
