"""The fact table on disk: written by month, read whatever its files' age, and corrected in place month by month.

Beside the table stands a JSON file of what its run says of itself.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.classify import HOUSEHOLD, Household, expense_amount
from granary.operators.corrections import CORRECTION, added_rules, correction_overrides
from granary.operators.dedupe import keep_first
from granary.operators.overrides import apply_overrides, merge_overrides
from granary.plans.rebuild import enrich, label_internal, transaction_key
from granary.sources.schemas import OVERRIDE, TXN
from granary.sources.settings import Settings, exists, listing, read_text, write_text
from granary.sources.storage import written

#: Where a file has no such column, or no value in it: what a row without it means.
BACKFILL: dict[str, Column | None] = {"internal_detection": "none", "category_source": "auto", "extraction_confidence": 1.0, "extraction_sources": "", "extraction_disagreement": False}
NO_MONTH = "none"
#: A month of the table is dealt over so many tasks and files.
FILES = 8


def _by_month(txn: DataFrame, files: int):
    txn = txn.withColumn("month", F.coalesce("month", F.lit(NO_MONTH)))
    return txn.repartition("month", F.pmod(F.xxhash64("tx_key"), F.lit(files))).write.mode("overwrite").partitionBy("month")


def write_facts(txn: DataFrame, path: str, files: int = FILES) -> None:
    """The fact table, partitioned by month: month filters prune its folders."""
    _by_month(txn, files).parquet(path)


def rewrite_months(txn: DataFrame, path: str, files: int = FILES) -> None:
    """Replaces the months that txn has, and no others.  txn may read from path: Spark writes beside it and moves folders when all is written."""
    _by_month(txn, files).option("partitionOverwriteMode", "dynamic").parquet(path)


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """The fact table, of each tx_key its first row.

    Files of older schemas lack columns: those of TXN that no file or only some files have are filled in, typed; a missing tx_key
    is built from its parts.  Columns that TXN does not know stay.  Of rows without ingest_pos (which no old file has) the
    one least by its other columns counts as first.
    """
    return keep_first(_filled(spark, path), ["tx_key"], "fa_order").drop("fa_order")


def _filled(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the fact table with its columns, and fa_order, which says which of a tx_key is first."""
    raw = spark.read.option("mergeSchema", "true").parquet(path)
    have, kinds = set(raw.columns), {f.name: f.dataType for f in TXN.fields}
    filled = raw.withColumns({n: F.lit(None).cast(k) for n, k in kinds.items() if n not in have and n != "month"})
    filled = filled.withColumns({n: F.col(n).cast(kinds[n]) for n in kinds if n in have and n != "month" and raw.schema[n].dataType != kinds[n]})
    filled = filled.withColumns({n: F.coalesce(n, F.lit(v)) for n, v in BACKFILL.items()})
    month = F.col("month").cast("string") if "month" in have else F.date_format("transaction_date", "yyyy-MM")
    filled = filled.withColumns({"tx_key": F.coalesce("tx_key", transaction_key()), "month": F.when(month != NO_MONTH, month)})
    parts = [F.coalesce("ingest_pos", F.lit(1 << 62)), *[F.col(n) for n in ("source_file", "posting_date", "owner", "notes")]]
    return filled.withColumn("fa_order", F.struct(*parts))


def reclassify(rows: DataFrame, rules=None, aliases=None, overrides: DataFrame | None = None, household: Household = HOUSEHOLD) -> DataFrame:
    """Rows of the fact table with targets by these rules and overrides; pairs and flows stay: they follow from the texts."""
    columns = rows.columns
    paired = F.col("fa_status") == "Matched"
    df = enrich(rows.withColumns({"fa_match": F.col("match_id"), "fa_status": F.col("internal_match_status")}).drop("merchant"), rules, aliases, household, clean=False)
    late = paired & ~F.col("is_internal_candidate")
    df = df.withColumns({
        "match_id": F.col("fa_match"), "internal_match_status": F.col("fa_status"), "is_internal_candidate": F.col("is_internal_candidate") | late,
        "matched_keyword": F.when(late & (F.trim("matched_keyword") == ""), "amount+timing").otherwise(F.col("matched_keyword")),
    })
    df = label_internal(df)
    if overrides is not None:
        df = apply_overrides(df, overrides, household)
    df = df.withColumn("expense_amount", expense_amount(F.col("amount"), F.col("statement_type"), F.col("flow_type"), F.col("is_internal")))
    return df.select(*columns)


def _state(spark: SparkSession, path: str, settings: Settings, *more) -> str:
    """What tells the files of the table and the settings apart from all others."""
    newest = settings.overrides_path()
    return hashlib.sha256(repr((listing(spark, path), newest and listing(spark, newest), more)).encode("utf-8")).hexdigest()


def apply_corrections(spark: SparkSession, path: str, settings: Settings, items: DataFrame, aliases=None, household: Household = HOUSEHOLD) -> list[str]:
    """Saves corrections and rewrites the months of the fact table at path that they touch; gives those months.

    items: rows of CORRECTION.  Rules that they add come before the others, the last one first; the latest correction of a key wins.
    A month is touched if it has a row of a corrected key, or one whose text has an added keyword.  Settings are
    saved first, so that a run that ends early is mended by running it again; a second run changes nothing.  A file beside the table
    names the months that its files hold by these settings already: they are not rewritten.
    """
    items = written(items.select(*CORRECTION.fieldNames()), "corrections")
    before = settings.load_rules()
    # rules a person adds in one request: a settings list
    added = [r.asDict() for r in added_rules(items).collect()]
    fresh = [r for r in reversed(added) if r not in before]
    if fresh:
        settings.save_rules([*fresh, *[r for r in before if r not in fresh]])
    wanted = correction_overrides(items)
    merged = merge_overrides(settings.load_overrides(), wanted).select(*OVERRIDE.fieldNames())
    if not merged.subtract(settings.load_overrides()).isEmpty():
        settings.save_overrides(merged)
    rules, overrides = settings.load_rules(), settings.load_overrides()
    said = F.lower(F.concat_ws(" ", "description", "merchant"))
    hit = F.lit(False)
    for r in added:
        hit = hit | said.contains(r["keyword"])
    keys = wanted.select(F.col("tx_key").alias("fa_key")).distinct()
    # one pass, whose rows carry whether their text is meant and not the text
    narrow = keep_first(_filled(spark, path).select("tx_key", "month", "fa_order", hit.alias("fa_hit")), ["tx_key"], "fa_order").select("tx_key", "month", "fa_hit")
    months = narrow.join(keys, F.col("tx_key") == F.col("fa_key"), "left").where("fa_hit or fa_key is not null").select("month")
    # a calendar's months
    touched = sorted(r[0] or NO_MONTH for r in months.distinct().collect())
    said_of, done = f"{path.rstrip('/')}-corrected.json", []
    if touched and exists(spark, said_of):
        try:
            known = json.loads(read_text(spark, said_of))
            done = known["months"] if known["state"] == _state(spark, path, settings, rules, aliases, household) else []
        except (ValueError, LookupError, TypeError):
            # a broken file knows of no month
            done = []
    left = sorted(set(touched) - set(done))
    if left:
        rows = read_facts(spark, path).where(F.coalesce("month", F.lit(NO_MONTH)).isin(left))
        rewrite_months(reclassify(rows, rules, aliases, overrides, household), path)
        write_text(spark, said_of, json.dumps({"state": _state(spark, path, settings, rules, aliases, household), "months": sorted({*left, *done})}))
    return touched


# --- what a run says of itself ---

META = T.StructType([
    T.StructField("updated_at", T.StringType()), T.StructField("warnings", T.ArrayType(T.StringType())), T.StructField("processed_files", T.ArrayType(T.StringType())),
    T.StructField("extraction_ensemble", T.StructType([
        T.StructField("mode", T.StringType()), T.StructField("backends_configured", T.ArrayType(T.StringType())), T.StructField("avg_confidence_global", T.DoubleType()),
        T.StructField("total_low_confidence", T.LongType()), T.StructField("total_disagreement_rows", T.LongType()), T.StructField("files_with_merge", T.LongType()), T.StructField("files_count", T.LongType()),
        T.StructField("files_at", T.StringType()),
    ])),
    T.StructField("broken", T.StringType()),
])


def write_meta(spark: SparkSession, path: str, updated_at: str, warnings: list[str], processed_files: list[str], ensemble: dict | None = None) -> None:
    """The run's JSON file.  Reports of single files are a table of their own, whose place the file names: it grows with the input."""
    meta = {"updated_at": updated_at, "warnings": warnings, "processed_files": processed_files} | ({"extraction_ensemble": ensemble} if ensemble is not None else {})
    write_text(spark, path, json.dumps(meta, indent=2))


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """One row of META; a missing or broken file gives no date and empty lists, a broken one also its text in ``broken``."""
    text = read_text(spark, path) if exists(spark, path) else None
    row = spark.createDataFrame([(text,)], "text string")
    parsed = F.from_json("text", META, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    got = row.select(parsed.alias("m")).select(*[F.col(f"m.{f}").alias(f) for f in META.fieldNames()])
    none = F.array().cast("array<string>")
    return got.withColumns({"warnings": F.coalesce("warnings", none), "processed_files": F.coalesce("processed_files", none)})


def extraction_quality(meta: DataFrame) -> DataFrame:
    """The dashboard's one row about extraction, with defaults where the run says nothing."""
    e = lambda n: F.col(f"extraction_ensemble.{n}")
    count = lambda n: F.coalesce(e(n), F.lit(0)).cast("long")
    return meta.select(
        e("mode").alias("mode"), F.coalesce(e("backends_configured"), F.array().cast("array<string>")).alias("backends"), e("avg_confidence_global").alias("avg_confidence"),
        count("total_low_confidence").alias("low_confidence_transactions"), count("total_disagreement_rows").alias("description_disagreements"),
        count("files_with_merge").alias("files_with_consensus_merge"), count("files_count").alias("files_analyzed"),
    )
