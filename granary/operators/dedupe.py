"""Duplicates within the ledger, and the consensus of several extractions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import dedupe_fingerprint, merge_fingerprint, money_text
from granary.sources.storage import written

#: So many repeated rows are not looked for in each task's memory.
MANY = 500_000


def row_fingerprint(said: Column | None = None) -> Column:
    """What makes two raw rows the same transaction; said: the description's fingerprint, where a column has it."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.concat_ws("|", blank(F.col("statement_id")), blank(F.col("account_last4")), blank(F.date_format("transaction_date", "yyyy-MM-dd")), dedupe_fingerprint(F.col("description")) if said is None else said, F.trim(blank(F.col("reference"))), money_text(F.col("amount")))


def keep_first(rows: DataFrame, keys: list[str], order: str = "ingest_pos") -> DataFrame:
    """The first row, by order, of each key: WindowGroupLimit drops the rest before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("kf_n", F.row_number().over(w)).where("kf_n = 1").drop("kf_n")


def without_repeats(rows: DataFrame, key: Column, order: str = "ingest_pos", keyed: DataFrame | None = None) -> DataFrame:
    """keep_first for a written table, a key without nulls and an order whose values differ: whole rows stay where they are.

    A hash of the key and the order are all that is dealt out; only rows whose hash occurs twice meet by the key itself, and what has an
    earlier row of its key is taken away.  keyed: the rows with what the key reads, where they lack it.
    """
    hashed = (rows if keyed is None else keyed).select(F.xxhash64(key).alias("wr_hash"), key.alias("wr_key"), F.col(order).alias("wr_order"))
    twice = hashed.groupBy("wr_hash").agg(F.count("*").alias("n")).where("n > 1").select("wr_hash")
    some = hashed.join(written(twice, "twice"), "wr_hash")
    later = some.withColumn("n", F.row_number().over(Window.partitionBy("wr_key").orderBy("wr_order"))).where("n > 1").select("wr_order")
    later = written(later, "later")
    # few are broadcast by their size; with many, rows are dealt out once and not sorted
    many = later.hint("shuffle_hash") if later.count() > MANY else later
    return rows.join(many, F.col(order) == F.col("wr_order"), "left_anti")


def consensus(rows: DataFrame, sources: int) -> DataFrame:
    """One row for each transaction that extractions (label) agree on, from rows (label, pos, transaction_date, amount, description, reference).

    Rows are clustered by date, amount and a 56-character fingerprint of their description.  Confidence is the share
    of the sources that have the row; the commonest description wins (the one seen first of equally common ones), of its
    spellings the longest; the commonest non-empty reference likewise.  Null dates and null amounts are values of their own.
    """
    keyed = rows.withColumn("fp", merge_fingerprint(F.col("description"))).withColumn("d", F.coalesce(F.date_format("transaction_date", "yyyy-MM-dd"), F.lit("")))
    keyed = keyed.withColumn("a", F.coalesce(F.col("amount").cast("string"), F.lit("")))
    keys = ["d", "a", "fp"]
    each = keyed.groupBy(*keys, "description").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    best = each.groupBy(*keys).agg(F.max_by("description", F.struct("n", -F.col("first"))).alias("common"), F.max_by("description", F.struct(F.length("description").alias("len"), -F.col("first"))).alias("description"))
    refs = keyed.where("coalesce(reference, '') <> ''").groupBy(*keys, "reference").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    refs = refs.groupBy(*keys).agg(F.max_by("reference", F.struct("n", -F.col("first"))).alias("reference"))
    whole = keyed.groupBy(*keys).agg(
        F.count_distinct("label").alias("labels"),
        F.array_join(F.sort_array(F.collect_set("label")), "+").alias("extraction_sources"),
        (F.count_distinct("description") > 1).alias("varied"),
        F.min("transaction_date").alias("transaction_date"),
        F.min("amount").alias("amount"),
        F.min("pos").alias("ingest_pos"),
    )
    got = whole.join(best, keys).join(refs, keys, "left")
    confidence = F.lit(1.0) if sources <= 1 else F.round(F.col("labels") / F.lit(sources), 4)
    return got.select(
        "transaction_date", "amount", "description", F.coalesce("reference", F.lit("")).alias("reference"), confidence.alias("extraction_confidence"), "extraction_sources",
        (F.col("varied") | (F.col("labels") < sources)).alias("extraction_disagreement") if sources > 1 else F.lit(False).alias("extraction_disagreement"), "ingest_pos",
    )


def extraction_report(merged: DataFrame, file_col: str, sources: int) -> DataFrame:
    """For each file: rows, mean confidence, rows of low confidence and disagreements."""
    low = max(0.5, (sources - 1) / sources) - 1e-6 if sources > 1 else 1.0 - 1e-6
    return merged.groupBy(file_col).agg(
        F.count("*").alias("rows_out"), F.round(F.avg("extraction_confidence"), 3).alias("avg_confidence"),
        F.count_if(F.col("extraction_confidence") < low).alias("low_confidence_rows"), F.count_if(F.col("extraction_disagreement")).alias("disagreement_rows"),
    )


def extraction_summary(reports: DataFrame) -> DataFrame:
    return reports.agg(
        F.round(F.avg("avg_confidence"), 3).alias("avg_confidence_global"), F.coalesce(F.sum("low_confidence_rows"), F.lit(0)).alias("total_low_confidence"),
        F.coalesce(F.sum("disagreement_rows"), F.lit(0)).alias("total_disagreement_rows"), F.count("*").alias("files"),
    )
