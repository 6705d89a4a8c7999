"""Schemas of the ledger's tables."""

from pyspark.sql import types as T

_S, _D, _B = T.StringType(), T.DateType(), T.BooleanType()
MONEY = T.DecimalType(18, 2)

RAW_TXN = T.StructType(
    [T.StructField(n, _S) for n in "statement_id source_file source_path source_kind statement_type account_name account_last4 account_label owner role household".split()]
    + [T.StructField("transaction_date", _D), T.StructField("posting_date", _D)]
    + [T.StructField(n, _S) for n in "transaction_date_raw posting_date_raw description reference".split()]
    + [T.StructField("amount", MONEY), T.StructField("balance", MONEY), T.StructField("currency", _S), T.StructField("statement_start", _D), T.StructField("statement_end", _D), T.StructField("notes", _S)]
)

TXN = T.StructType(
    RAW_TXN.fields
    + [T.StructField("ingested_file", _S), T.StructField("extraction_confidence", T.DoubleType()), T.StructField("extraction_sources", _S), T.StructField("extraction_disagreement", _B)]
    + [T.StructField("merchant", _S), T.StructField("flow_type", _S), T.StructField("is_internal_candidate", _B), T.StructField("cash_flow_amount", MONEY), T.StructField("match_id", _S)]
    + [T.StructField("internal_match_status", _S), T.StructField("is_internal", _B)]
    + [T.StructField(n, _S) for n in "category necessity beneficiary matched_keyword tx_key category_source".split()]
    + [T.StructField("expense_amount", MONEY), T.StructField("month", _S), T.StructField("weekday", _S), T.StructField("statement_count_hint", T.IntegerType()), T.StructField("internal_detection", _S)]
    + [T.StructField("ingest_pos", T.LongType())]
)

CATEGORY_RULE = T.StructType([T.StructField(n, _S) for n in ("keyword", "category", "necessity", "beneficiary")])
OVERRIDE = T.StructType([T.StructField(n, _S) for n in ("tx_key", "category", "necessity", "beneficiary")])
EXTRACTION = T.StructType([T.StructField(n, _S) for n in "filename stem account_kind account_last4 account_key statement_month statement_date source_path csv_path extract_status".split()] + [T.StructField("row_count", T.LongType()), T.StructField("extract_error", _S)])
