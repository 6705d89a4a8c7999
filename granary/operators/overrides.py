"""User corrections by transaction key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import classify as c
from granary.functions.fixed import AUTO, BENEFICIARIES, CATEGORIES, NECESSITIES, words
from granary.functions.text import normalize_text


def valid_overrides(overrides: DataFrame, household: c.Household = c.HOUSEHOLD) -> DataFrame:
    """Unknown categories are dropped; Auto targets are resolved as for owner Household.

    One row for each key: of several, also of keys that only white space tells apart, the one of largest seq, if there is a column
    seq, and else the last in order of its targets.
    """
    last = F.col("seq").cast("long") if "seq" in overrides.columns else F.lit(0).cast("long")
    o = overrides.select(last.alias("seq"), *[normalize_text(F.col(n)).alias(n) for n in ("tx_key", "category", "necessity", "beneficiary")])
    o = o.where(F.col("category").isin(words(CATEGORIES)) & (F.col("tx_key") != ""))
    necessity, beneficiary = c.resolve_targets(F.lit("Household"), F.col("category"), F.col("necessity"), F.col("beneficiary"), household)
    targets = F.struct("seq", "category", necessity.alias("necessity"), beneficiary.alias("beneficiary"))
    return o.groupBy("tx_key").agg(F.max(targets).alias("o")).select("tx_key", "o.category", "o.necessity", "o.beneficiary")


def merge_overrides(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert: of several rows for a key the latest wins; within new, the one of largest seq."""
    both = old.withColumn("seq", F.lit(-1).cast("long")).unionByName(new)
    w = Window.partitionBy("tx_key").orderBy(F.desc("seq"))
    return both.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "seq")


def apply_overrides(rows: DataFrame, overrides: DataFrame, household: c.Household = c.HOUSEHOLD) -> DataFrame:
    """Overrides replace the three targets; flows and pairing stay as they are."""
    o = valid_overrides(overrides, household).select(F.col("tx_key").alias("o_key"), *[F.col(n).alias(f"o_{n}") for n in ("category", "necessity", "beneficiary")])
    got = rows.join(o, F.col("tx_key") == F.col("o_key"), "left")
    hit = F.col("o_key").isNotNull()
    targets = {n: F.when(hit, F.col(f"o_{n}")).otherwise(F.col(n)) for n in ("category", "necessity", "beneficiary")}
    more = {"category_source": F.when(hit, "override").otherwise(F.col("category_source")), "matched_keyword": F.when(hit, "").otherwise(F.col("matched_keyword"))}
    return got.withColumns(targets | more).drop("o_key", "o_category", "o_necessity", "o_beneficiary")


def valid_rules(rules: DataFrame, *keep: str) -> DataFrame:
    """Category rules with known values, and the columns keep: unknown categories become Other, unknown targets Auto, empty keywords go."""
    r = rules.select(*keep, F.lower(normalize_text(F.col("keyword"))).alias("keyword"), *[normalize_text(F.col(n)).alias(n) for n in ("category", "necessity", "beneficiary")])
    known = lambda n, values, default: F.when(F.col(n).isin(words(values)), F.col(n)).otherwise(default).alias(n)
    return r.where("keyword <> ''").select(*keep, "keyword", known("category", CATEGORIES, "Other"), known("necessity", NECESSITIES, AUTO), known("beneficiary", BENEFICIARIES, AUTO))
