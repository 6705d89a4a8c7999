"""The audit as one job: statement files are parsed once, and what was parsed feeds four datasets and their CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from granary.operators import coverage, reconcile
from granary.plans.reports import audit_counts, write_reports
from granary.sources.statements import parse_statements, statement_meta
from granary.sources.storage import written


def _stem(name: str = "name"):
    return F.regexp_replace(name, r"\.[A-Za-z]+$", "")


def run_audit(files: DataFrame, only: str | None = None) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """Datasets of statements (name, text), and counts taken while the files were parsed.

    statement_extraction: each file with its account, month, status, rows and error.  statement_reconciliation: the totals
    that its text states against the sums of its rows.  account_month_coverage and account_summary: the calendar.  statement_rows: all rows.
    Counts: rows and errors, and the files of empty text.  only: one dataset's name, where no other is needed.
    """
    seen, parsed_rows = Observation("files"), Observation("rows")
    # texts may be costly to come by, and two passes read them
    files = files.withColumn("text", F.coalesce("text", F.lit(""))).observe(seen, F.count("*").alias("files"), F.count_if(F.length("text") < 50).alias("empty_files"))
    files = written(files, "audit-texts")
    rows = parse_statements(files).observe(parsed_rows, F.count_if(F.col("error").isNull()).alias("rows"), F.count_if(F.col("error").isNotNull()).alias("errors"))
    rows = written(rows, "audit-rows")
    meta = {n: c for n, c in statement_meta(_stem()).items()}
    # the texts are read once for what they state, and not carried on; the kind, which both totals ask for, is a column first
    stated_in, stated_out = reconcile.stated_totals(F.col("kind"), F.col("text"))
    kinds = files.withColumn("kind", reconcile.statement_kind(F.col("name"), F.col("text")))
    named = written(kinds.select(F.col("name").alias("filename"), *[c.alias(n) for n, c in meta.items()], "kind", stated_in.alias("statement_in"), stated_out.alias("statement_out")), "audit-files")
    good = rows.where("error is null").withColumnRenamed("source_file", "filename")
    errors = rows.where("error is not null").groupBy(F.col("source_file").alias("filename")).agg(F.min("error").alias("extract_error"))
    # each file once, with what its rows sum up to: both reports are columns of it
    found = reconcile.with_sums(named, good, "filename").join(errors, "filename", "left")
    found = found.withColumns({"extract_status": F.when(F.col("extract_error").isNull(), "ok").otherwise("error"), "extract_error": F.coalesce("extract_error", F.lit(""))})
    columns = ["filename", *meta, "row_count", "extract_error", "extract_status"]
    extraction = found.select(*columns)
    datasets = {"statement_extraction": extraction, "statement_rows": good.drop("error")}
    if only not in datasets:
        checked = reconcile.checked(found.withColumn("extract_row_count", F.col("row_count")), *[c.replace("row_count", "extract_row_count") for c in columns]).drop("row_count")
        reconciliation = checked.withColumnsRenamed({"kind": "reconcile_kind", "ok": "reconcile_ok"})
        datasets["statement_reconciliation"] = reconciliation
        if only != "statement_reconciliation":
            reconciliation = written(reconciliation, "audit-reconciliation")
            months = coverage.account_months(reconciliation.where("account_key <> 'unknown' and statement_month is not null"))
            datasets |= {"statement_reconciliation": reconciliation, "account_month_coverage": months, "account_summary": coverage.account_gaps(months)}
    return datasets, {**seen.get, **parsed_rows.get}


def audit_folder(spark: SparkSession, files: DataFrame, folder: str) -> dict[str, int]:
    """run_audit with its four reports as CSV under folder; gives the counts, those of the reports too."""
    datasets, counts = run_audit(files)
    write_reports({n: df for n, df in datasets.items() if n != "statement_rows"}, folder)
    return counts | audit_counts(datasets["statement_reconciliation"]).first().asDict()
