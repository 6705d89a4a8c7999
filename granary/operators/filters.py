"""One predicate from a filter specification."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import fixed
from granary.functions.fixed import words
from granary.functions.text import has_any, normalize_text

SEARCH_LENGTH = 200


@dataclass(frozen=True)
class Filters:
    owner: str | None = None
    account: str | None = None
    category: str | None = None
    necessity: str | None = None
    beneficiary: str | None = None
    month: str | None = None
    year: int | None = None
    include_internal: bool = False
    exclude_owners: list[str] = field(default_factory=list)
    exclude_accounts: list[str] = field(default_factory=list)
    exclude_categories: list[str] = field(default_factory=list)
    exclude_necessities: list[str] = field(default_factory=list)
    exclude_beneficiaries: list[str] = field(default_factory=list)
    exclude_merchants: list[str] = field(default_factory=list)
    text: str | None = None


def predicate(f: Filters) -> Column:
    """The conjunction of what is set.  A year becomes a range of dates, so that it reaches the scan; excluded lists keep nulls."""
    parts = [F.col(c) == v for c, v in (("owner", f.owner), ("account_label", f.account), ("category", f.category), ("necessity", f.necessity), ("beneficiary", f.beneficiary), ("month", f.month)) if v]
    if f.year:
        parts.append(F.col("transaction_date").between(F.lit(f"{f.year:04d}-01-01").cast("date"), F.lit(f"{f.year:04d}-12-31").cast("date")))
    if not f.include_internal:
        parts.append(~F.coalesce("is_internal", F.lit(False)))
    for c, values in (
        ("owner", f.exclude_owners), ("account_label", f.exclude_accounts), ("category", f.exclude_categories),
        ("necessity", f.exclude_necessities), ("beneficiary", f.exclude_beneficiaries), ("merchant", f.exclude_merchants),
    ):
        values = [str(v).strip() for v in values or [] if str(v).strip()]
        if values:
            parts.append(~F.coalesce(F.col(c).isin(values), F.lit(False)))
    needle = (f.text or "").strip()[:SEARCH_LENGTH].lower()
    if needle:
        parts.append(reduce(Column.__or__, [F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(needle)) for c in ("category", "merchant", "description")]))
    return reduce(Column.__and__, parts, F.lit(True))


def apply_filters(df: DataFrame, f: Filters) -> DataFrame:
    return df.where(predicate(f))


def ledger_text() -> Column:
    return F.concat_ws(" ", F.lower(normalize_text(F.col("description"))), F.lower(normalize_text(F.col("merchant"))))


def true_cash_in() -> Column:
    """Pay and other income from outside, without refunds and card credits."""
    external = ~F.coalesce("is_internal", F.lit(False))
    return (F.col("cash_flow_amount") > 0) & external & (F.col("flow_type") == "Income") & ~has_any(ledger_text(), words(fixed.RETAIL_CREDIT_WORDS))


def hard_cash_out() -> Column:
    """Cash withdrawals, and debits of no category that are no purchase, bill or mortgage."""
    text, external = ledger_text(), ~F.coalesce("is_internal", F.lit(False))
    other = (F.col("category") == "Other") & ~has_any(text, words(fixed.PURCHASE_OR_BILL_WORDS)) & ~text.rlike(fixed.MORTGAGE_PATTERN)
    return (F.col("cash_flow_amount") < 0) & external & (has_any(text, words(fixed.CASH_OUT_WORDS)) | other)


def needs_review() -> Column:
    """No category, no known merchant or no rule; never what the user has corrected."""
    blank = F.trim(F.coalesce("matched_keyword", F.lit(""))) == ""
    ruleless = blank & F.col("flow_type").isin("Expense", "Fees") & ~F.col("category").isin("Internal Transfer", "Income", "Refund")
    unknown = F.lower(F.coalesce("merchant", F.lit(""))).startswith("unknown")
    return ((F.col("category") == "Other") | unknown | ruleless) & (F.coalesce("category_source", F.lit("")) != "override")
