"""Calendars of statements: which account has which month, and where the gaps are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("chequing", "visa", "mastercard", "credit_line")


def account_months(reconciled: DataFrame) -> DataFrame:
    """Each account by each month between the first and the last: full, partial or missing.

    reconciled: account_key, account_kind, account_last4, statement_month (yyyy-MM), extract_row_count, reconcile_ok, filename, notes.
    The calendar is a sequence over the two outermost months; accounts times months is the size of the result.
    """
    known = reconciled.where("account_key is not null and account_key <> 'unknown' and statement_month is not null")
    span = known.agg(F.min("statement_month").alias("a"), F.max("statement_month").alias("b")).where("a is not null")
    months = span.select(F.explode(F.expr("sequence(to_date(a || '-01'), to_date(b || '-01'), interval 1 month)")).alias("d")).select(F.date_format("d", "yyyy-MM").alias("month"))
    # distinct ones are few; least strings by key are found by sorting
    accounts = known.select("account_key", "account_kind", "account_last4", "statement_month").distinct().groupBy("account_key").agg(F.min_by("account_kind", "statement_month").alias("account_kind"), F.min_by("account_last4", "statement_month").alias("account_last4"))
    held = known.groupBy("account_key", F.col("statement_month").alias("month")).agg(
        F.bool_or(F.coalesce("reconcile_ok", F.lit(False))).alias("ok"), F.sum(F.coalesce("extract_row_count", F.lit(0))).alias("rows"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("filename", "notes"))), lambda x: F.coalesce(x["filename"], F.lit(""))), "; ").alias("names"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("filename", "notes"))), lambda x: F.coalesce(x["notes"], F.lit(""))), " | ").alias("said"),
    )
    grid = accounts.crossJoin(F.broadcast(months)).join(held, ["account_key", "month"], "left")
    status = F.when(F.col("ok").isNull(), "missing").when(F.col("ok"), "full").otherwise("partial")
    return grid.select(
        "account_key", "account_kind", "account_last4", "month", status.alias("status"), F.coalesce("ok", F.lit(False)).alias("reconcile_ok"), F.coalesce("rows", F.lit(0)).cast("long").alias("row_count"),
        F.coalesce("names", F.lit("")).alias("filenames"), F.coalesce("said", F.lit("No statement file for this account/month.")).alias("notes"),
    )


def account_gaps(coverage: DataFrame) -> DataFrame:
    """For each account its months by status, and its missing months before, between and after those it has."""
    there = F.col("status") != "missing"
    w = Window.partitionBy("account_key")
    marked = coverage.withColumn("first", F.min(F.when(there, F.col("month"))).over(w)).withColumn("last", F.max(F.when(there, F.col("month"))).over(w))
    gap = F.when(there, "none").when(F.col("month") < F.col("first"), "leading").when(F.col("month") > F.col("last"), "trailing").when(F.col("first").isNotNull(), "middle").otherwise("none")
    marked = marked.withColumn("gap", gap)
    months = lambda c: F.array_join(F.sort_array(F.collect_list(F.when(c, F.col("month")))), ", ")
    return marked.groupBy("account_key").agg(
        F.min("account_kind").alias("account_kind"), F.min("account_last4").alias("account_last4"), F.count_if(F.col("status") == "full").alias("months_full"), F.count_if(F.col("status") == "partial").alias("months_partial"),
        F.count_if(F.col("status") == "missing").alias("months_missing"), F.count_if(F.col("gap") == "middle").alias("middle_missing_count"), months(F.col("gap") == "middle").alias("middle_missing_months"),
        months(F.col("gap") == "leading").alias("leading_missing_months"), months(F.col("gap") == "trailing").alias("trailing_missing_months"), F.bool_or(F.col("gap") == "middle").alias("has_middle_gap"),
        months(there).alias("available_months"), F.coalesce(F.min("first"), F.lit("")).alias("first_month"), F.coalesce(F.max("last"), F.lit("")).alias("last_month"),
    )


def expectations(files: DataFrame, counts: dict[str, int] | None = None, exact: dict[str, list[str]] | None = None) -> DataFrame:
    """Statements of each month held against expected accounts: an exact list of last digits, else a count of them.

    files: month, kind (one of KINDS), last4, stem.  One pivot-free pass; issues is an array and ok its emptiness.
    """
    counts, exact = counts or {}, exact or {}
    found = files.groupBy("month").agg(
        F.count("*").alias("pdf_count"),
        *[F.sort_array(F.collect_set(F.when(F.col("kind") == k, F.col("last4")))).alias(k) for k in KINDS],
        *[F.count_if(F.col("kind") == k).alias(f"{k}_files") for k in KINDS],
    )
    issues = []
    for k in KINDS:
        if exact.get(k) is not None:
            want = sorted(exact[k])
            listed = F.array(*[F.lit(x) for x in want]) if want else F.array().cast("array<string>")
            issues.append(F.when(F.col(k) != listed, F.concat(F.lit(f"{k}: expected {', '.join(want)}, found "), F.array_join(k, ", "))))
        elif counts.get(k) is not None:
            issues.append(F.when(F.size(k) != counts[k], F.concat(F.lit(f"{k}: expected {counts[k]} accounts, found "), F.size(k).cast("string"))))
        issues.append(F.when(F.col(f"{k}_files") > F.size(k), F.lit(f"{k}: several files for one account")))
    listed = F.array_compact(F.array(*issues))
    return found.withColumn("issues", F.array_join(listed, "; ")).withColumn("ok", F.size(listed) == 0).drop(*[f"{k}_files" for k in KINDS])
