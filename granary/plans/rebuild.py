"""From raw rows to the enriched fact table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import classify as c
from granary.functions.text import dedupe_fingerprint, haystack, money_text, normalize_text, title_case
from granary.operators.dedupe import row_fingerprint, without_repeats
from granary.operators.overrides import apply_overrides
from granary.operators.rules import ARRAY_RULES, FIELDS, match_rules
from granary.operators.transfers import pair_transfers
from granary.sources.storage import written


#: What enrich() takes from a description's wording, for its rows.
SAID = ("en_flow", "en_inner", "en_income", "en_category", "en_keyword", "en_necessity", "en_for")


def transaction_key() -> Column:
    """Six parts of a transaction that identify it across rebuilds."""
    blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    return F.concat_ws("|", blank("statement_id"), blank("account_last4"), F.coalesce(F.date_format("transaction_date", "yyyy-MM-dd"), F.lit("")), blank("description"), blank("reference"), money_text(F.col("amount")))


def enrich(raw: DataFrame, rules: list[dict[str, str]] | None = None, aliases: list[tuple[str, str]] | None = None, household: c.Household = c.HOUSEHOLD, full_html: bool = False, clean: bool = True) -> DataFrame:
    """Adds merchant, flow, classification, keys and calendar columns; needs the columns that raw_ledger() has.

    What follows from the description alone (its plain text, merchant, rule, and all that its wording says) is worked out once for each
    distinct description, written, and joined back, so that a row looks up no words: Spark broadcasts that table under its size threshold and deals it out beyond.  full_html decodes every character
    reference in an Arrow UDF; otherwise the common ones are replaced in the JVM.  Descriptions that were cleaned before (clean=False) stay as they are.
    """
    df = raw.withColumns({
        "reference": F.coalesce(F.col("reference").cast("string"), F.lit("")),
        "owner": F.coalesce("owner", F.lit("Household")),
        "amount": F.coalesce(F.col("amount").cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)")),
    })
    said = df.select(F.col("description").alias("en_raw")).distinct()
    said = said.withColumn("en_said", normalize_text(F.col("en_raw"), full_html) if clean else F.col("en_raw"))
    # what later expressions use more than once is a column of its own, so that it is evaluated once
    said = said.withColumns({"en_text": F.lower("en_said"), "en_hay": haystack(F.lower("en_said")), "en_name": c.bare_name(F.col("en_said"))})
    said = said.withColumn("merchant", F.coalesce(c.canonical_merchant("en_hay", aliases), F.when(F.col("en_name") != "", title_case(F.col("en_name"))), F.lit("Unknown Merchant")))
    said = said.withColumn("en_both", F.trim(F.concat_ws(" ", "en_text", F.lower("merchant"))))
    if rules is not None and len(rules) > ARRAY_RULES:
        listed = raw.sparkSession.createDataFrame([(i, *[r[f] for f in FIELDS]) for i, r in enumerate(rules)], "pos long, keyword string, category string, necessity string, beneficiary string")
        said = written(said, "descriptions")
        found = match_rules(said.select("en_both").distinct(), "en_both", listed, "en_found").withColumnRenamed("en_both", "en_key")
        said = said.join(found, F.col("en_both") == F.col("en_key"), "left").drop("en_key")
    else:
        said = said.withColumn("en_found", c.match_rule("en_both", rules))
    said = said.withColumns({"en_flow": c.worded_flow(F.col("en_text")), "en_inner": c.worded_candidate(F.col("en_text"))} | c.worded_targets(F.col("en_both"), F.col("en_found"), household))
    said = written(said.select("en_raw", "en_said", "merchant", *SAID), "descriptions")
    df = df.join(said, F.col("description").eqNullSafe(F.col("en_raw"))).withColumn("description", F.col("en_said")).drop("en_raw", "en_said")
    df = df.withColumn("flow_type", c.signed_flow(F.col("en_flow"), F.col("amount"), F.col("statement_type")))
    df = df.withColumns({
        "is_internal_candidate": F.when(F.col("flow_type") == "Internal Transfer", True).otherwise(F.col("en_inner")),
        "cash_flow_amount": c.cash_flow_amount(F.col("amount"), F.col("statement_type")),
        "match_id": F.lit(""),
        "internal_match_status": F.lit("None"),
        "is_internal": F.col("flow_type") == "Internal Transfer",
    })
    df = df.withColumns(c.classified(F.col("owner"), F.col("flow_type"), household)).drop(*SAID)
    return df.withColumns({
        "tx_key": transaction_key(),
        "category_source": F.when(F.trim("matched_keyword") != "", "rule").otherwise("auto"),
        "expense_amount": c.expense_amount(F.col("amount"), F.col("statement_type"), F.col("flow_type"), F.col("is_internal")),
        "month": F.date_format("transaction_date", "yyyy-MM"),
        "weekday": F.date_format("transaction_date", "EEEE"),
        "statement_count_hint": F.lit(1),
        "internal_detection": F.lit("none"),
    })


def label_internal(df: DataFrame) -> DataFrame:
    """Category, flow and detection of paired and keyword-internal rows."""
    paired = F.col("internal_match_status") == "Matched"
    keyword = F.col("flow_type") == "Internal Transfer"
    waiting = F.col("is_internal_candidate") & (F.col("internal_match_status") == "Unmatched")
    return df.withColumns({
        "internal_detection": F.when(paired, "paired").when(keyword, "keyword").when(waiting, "unmatched_candidate").otherwise("none"),
        "category_source": F.when(paired, "internal_pair").when(keyword, "internal_keyword").otherwise(F.col("category_source")),
        "matched_keyword": F.when(paired & (F.coalesce("matched_keyword", F.lit("")) == ""), "paired transfer").otherwise(F.col("matched_keyword")),
        "flow_type": F.when(paired, "Internal Transfer").otherwise(F.col("flow_type")),
        "category": F.when(paired, "Internal Transfer").otherwise(F.col("category")),
        "necessity": F.when(paired, "Savings & Transfers").otherwise(F.col("necessity")),
        "beneficiary": F.when(paired, "Shared").otherwise(F.col("beneficiary")),
        "is_internal": paired | keyword,
    })


def rebuild(raw: DataFrame, rules=None, aliases=None, overrides: DataFrame | None = None, household: c.Household = c.HOUSEHOLD, full_html: bool = True) -> DataFrame:
    """raw rows (with ingest_pos, their order) to the enriched, deduplicated and paired fact table, in ledger order."""
    raw = written(raw, "raw")
    # a fingerprint is made once for each distinct description
    said = written(raw.select(F.col("description").alias("rb_raw")).distinct().withColumn("rb_said", dedupe_fingerprint(F.col("rb_raw"))), "fingerprints")
    first = without_repeats(raw, row_fingerprint(F.col("rb_said")), keyed=raw.join(said, F.col("description").eqNullSafe(F.col("rb_raw"))))
    # whole rows are written here and at the end; between, what is taken away or paired is a narrow table
    rows = without_repeats(written(enrich(first, rules, aliases, household, full_html), "enriched"), F.col("tx_key"))
    rows = label_internal(pair_transfers(rows))
    if overrides is not None:
        rows = apply_overrides(rows, overrides, household)
    rows = rows.withColumn("expense_amount", c.expense_amount(F.col("amount"), F.col("statement_type"), F.col("flow_type"), F.col("is_internal")))
    return rows.orderBy(F.asc_nulls_last("transaction_date"), F.asc_nulls_last("account_label"), F.desc_nulls_last("amount"), "ingest_pos")
