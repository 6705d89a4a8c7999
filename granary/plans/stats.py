"""Batch statistics over the months whose statements reconcile.

Null keys stay groups here.  Totals are sums of amounts already rounded to cents, which decimals keep exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import classify as c
from granary.sources.storage import written

CARDS = ("visa", "mastercard")


def _d(x: Column, digits: int = 2) -> Column:
    return F.round(x, digits).cast("double")


def _joined(column: str, condition: Column | None = None) -> Column:
    value = F.col(column) if condition is None else F.when(condition, F.col(column))
    return F.array_join(F.sort_array(F.collect_set(value)), ", ")


def calendar(coverage: DataFrame) -> DataFrame:
    """What full_rows() needs of account_months(): no file names, which grow with the statements."""
    return coverage.select("account_key", "month", "status")


def full_rows(rows: DataFrame, coverage: DataFrame) -> DataFrame:
    """Rows of the account-months that are full: a semi join on the calendar's keys."""
    keys = coverage.where("status = 'full'").select("account_key", F.col("month").alias("statement_month"))
    return rows.join(keys, ["account_key", "statement_month"], "left_semi")


def summarize(rows: DataFrame, keys: list[str]) -> DataFrame:
    zero = F.lit(0).cast("decimal(18,2)")
    got = rows.groupBy(*keys).agg(F.count("*").alias("transaction_count"), F.sum(F.greatest("amount", zero)).alias("cash_in"), F.sum(F.greatest(-F.col("amount"), zero)).alias("cash_out"), F.sum("amount").alias("net_cash_flow"))
    return got.withColumn("absolute_activity", F.col("cash_in") + F.col("cash_out"))


def account_month(rows: DataFrame) -> DataFrame:
    return summarize(rows, ["account_key", "account_kind", "account_last4", "statement_month"])


def account_summary(months: DataFrame) -> DataFrame:
    got = months.groupBy("account_key", "account_kind", "account_last4").agg(
        F.count_distinct("statement_month").alias("full_months"), F.sum("transaction_count").alias("transaction_count"), F.sum("cash_in").alias("in_"), F.sum("cash_out").alias("out_"), F.sum("net_cash_flow").alias("net"), F.sum("absolute_activity").alias("act")
    )
    n = F.greatest(F.lit(1), F.col("full_months"))
    return got.select(
        "account_key", "account_kind", "account_last4", "full_months", "transaction_count", _d(F.col("in_")).alias("total_cash_in"), _d(F.col("out_")).alias("total_cash_out"), _d(F.col("net")).alias("total_net_cash_flow"), _d(F.col("act")).alias("total_activity"),
        _d(F.col("in_") / n).alias("avg_monthly_cash_in"), _d(F.col("out_") / n).alias("avg_monthly_cash_out"), _d(F.col("net") / n).alias("avg_monthly_net_cash_flow"), _d(F.col("act") / n).alias("avg_monthly_activity"),
    )


def monthly_total(rows: DataFrame, months: DataFrame) -> DataFrame:
    accounts = months.where("statement_month is not null").groupBy("statement_month").agg(F.count_distinct("account_key").alias("full_account_count"))
    return summarize(rows, ["statement_month"]).join(accounts, "statement_month", "left")


def credit_by_month(months: DataFrame) -> DataFrame:
    """Card spending by month, and whether every card has that month."""
    cards = months.where(F.col("account_kind").isin(*CARDS))
    expected = cards.agg(F.count_distinct("account_key").alias("expected_credit_card_count"))
    got = cards.groupBy("statement_month").agg(
        F.sum("cash_in").alias("credit_card_expense"), F.sum("cash_out").alias("credit_card_payments_credits"), F.sum("net_cash_flow").alias("net_credit_card_activity"), F.sum("transaction_count").alias("credit_card_transactions"), F.count_distinct("account_key").alias("full_credit_card_count"),
    )
    return got.crossJoin(F.broadcast(expected)).withColumn("all_credit_cards_present", F.col("full_credit_card_count") == F.col("expected_credit_card_count"))


def credit_summary(by_month: DataFrame, months: DataFrame) -> DataFrame:
    done = F.col("all_credit_cards_present")
    cards = months.where(F.col("account_kind").isin(*CARDS)).agg(_joined("account_key").alias("credit_card_accounts"))
    got = by_month.agg(F.count_if(done).alias("n"), F.coalesce(F.sum(F.when(done, F.col("credit_card_expense"))), F.lit(0)).alias("t"), _joined("statement_month", done).alias("months_included"), _joined("statement_month", ~done).alias("months_excluded_as_partial"))
    return cards.crossJoin(got).select(
        "credit_card_accounts", F.col("n").alias("complete_credit_card_months"), _d(F.col("t")).alias("total_credit_card_expense_complete_months"), _d(F.col("t") / F.greatest(F.lit(1), F.col("n"))).alias("avg_monthly_credit_card_expense_complete_months"), "months_included", "months_excluded_as_partial",
    )


def totals(months: DataFrame) -> DataFrame:
    got = months.agg(
        F.count("*").alias("full_account_months"), F.count_distinct("account_key").alias("full_accounts"), F.count_distinct("statement_month").alias("m"), F.coalesce(F.sum("transaction_count"), F.lit(0)).alias("transaction_count"),
        *[F.coalesce(F.sum(x), F.lit(0).cast("decimal(18,2)")).alias(x) for x in ("cash_in", "cash_out", "net_cash_flow")],
    )
    n = F.greatest(F.lit(1), F.col("m"))
    return got.select(
        "full_account_months", "full_accounts", F.col("m").alias("months_with_any_full_accounts"), "transaction_count", *[_d(F.col(x)).alias(f"total_{x}") for x in ("cash_in", "cash_out", "net_cash_flow")], *[_d(F.col(x) / n).alias(f"avg_monthly_{x}") for x in ("cash_in", "cash_out", "net_cash_flow")],
    )


def complete_months(by_month: DataFrame) -> DataFrame:
    return by_month.where("all_credit_cards_present").select("statement_month")


def wording(rows: DataFrame, household: c.Household = c.HOUSEHOLD) -> DataFrame:
    """What the batch takes from a description's wording, once for each distinct description, written: ladders too long for the rows."""
    said, text = rows.select(F.col("description").alias("sw_said")).distinct(), F.col("sw_said")
    return written(said.withColumns({
        "sw_own": c.is_own_transfer(text, household), "smart_category": c.spend_group(text), "income_source": c.income_source(text, household), "is_internal_inflow": c.is_internal_inflow(text, household),
    }), "wording")


def _worded(rows: DataFrame, words: DataFrame, *columns: str) -> DataFrame:
    return rows.join(words.select("sw_said", *columns), F.col("description").eqNullSafe(F.col("sw_said"))).drop("sw_said")


def spend_rows(rows: DataFrame, months: DataFrame, words: DataFrame) -> DataFrame:
    """Card purchases and chequing debits of complete months, without transfers between own accounts: one scan.  words: wording() of the rows, or of more."""
    work = rows.join(months, "statement_month", "left_semi")
    card = F.col("account_kind").isin(*CARDS) & (F.col("amount") > 0)
    debit = (F.col("account_kind") == "chequing") & (F.col("amount") < 0)
    got = _worded(work.where(card | debit), words, "sw_own", "smart_category").where(card | ~F.col("sw_own")).drop("sw_own")
    return got.withColumns({"expense_amount": F.abs("amount"), "spend_source": F.when(F.col("account_kind") == "chequing", "debit_bank").otherwise("credit_card")})


def category_summary(spend: DataFrame, months: DataFrame) -> DataFrame:
    got = spend.groupBy(F.col("smart_category").alias("category")).agg(F.sum("expense_amount").alias("t"), F.count("*").alias("transaction_count"), F.count_distinct("statement_month").alias("months_count"))
    n = months.agg(F.greatest(F.lit(1), F.count("*")).alias("n"))
    share = F.col("t") / F.sum("t").over(Window.partitionBy())
    got = got.withColumn("share", share).crossJoin(F.broadcast(n))
    return got.select("category", _d(F.col("t")).alias("total_expense"), _d(F.col("share") * 100).alias("share_of_total"), "transaction_count", _d(F.col("t") / F.col("transaction_count")).alias("avg_transaction"), "months_count", _d(F.col("t") / F.col("n")).alias("avg_monthly_expense"))


def category_by(spend: DataFrame, key: str) -> DataFrame:
    return spend.groupBy(key, F.col("smart_category").alias("category")).agg(_d(F.sum("expense_amount")).alias("expense"), F.count("*").alias("transaction_count"))


def card_spend(spend: DataFrame) -> DataFrame:
    return spend.where("spend_source = 'credit_card'")


def spend_line_items(spend: DataFrame) -> DataFrame:
    rows = spend.select("statement_month", "account_key", "spend_source", "transaction_date", "description", _d(F.col("expense_amount")).alias("amount"), F.col("smart_category").alias("category"))
    return rows.orderBy("statement_month", "category", F.desc("amount"), "account_key", "description")


def spend_totals(spend: DataFrame, months: DataFrame) -> DataFrame:
    part = lambda s: F.coalesce(F.sum(F.when(F.col("spend_source") == s, F.col("expense_amount"))), F.lit(0))
    got = spend.agg(F.coalesce(F.sum("expense_amount"), F.lit(0)).alias("t"), part("credit_card").alias("cc"), part("debit_bank").alias("db"))
    m = months.agg(_joined("statement_month").alias("months_included"), F.greatest(F.lit(1), F.count("*")).alias("n"))
    return got.crossJoin(m).select("months_included", _d(F.col("t")).alias("total_expense"), _d(F.col("cc")).alias("credit_card_expense"), _d(F.col("db")).alias("debit_bank_expense"), _d(F.col("t") / F.col("n")).alias("avg_monthly_total_expense"))


def inflows(rows: DataFrame, months: DataFrame, words: DataFrame) -> DataFrame:
    got = rows.where("account_kind = 'chequing' and amount > 0").join(months, "statement_month", "left_semi")
    return _worded(got, words, "income_source", "is_internal_inflow")


def income_check(inflow: DataFrame, months: DataFrame, household: c.Household = c.HOUSEHOLD) -> DataFrame:
    """Income by month, months without any as zeros, and a TOTAL row; one payroll column for each employer."""
    zero = F.lit(0).cast("decimal(18,2)")
    pay = {f"payroll_{i + 1}": name for i, (_, name) in enumerate(household.employers)}
    sums = inflow.groupBy("statement_month").agg(
        F.sum("amount").alias("total_bank_cash_in"), F.coalesce(F.sum(F.when(F.col("is_internal_inflow"), F.col("amount"))), zero).alias("excluded_internal_cash_in"),
        *[F.coalesce(F.sum(F.when(F.col("income_source") == name, F.col("amount"))), zero).alias(p) for p, name in pay.items()],
    )
    columns = ["total_bank_cash_in", "excluded_internal_cash_in", *pay]
    got = months.join(sums, "statement_month", "left").select("statement_month", *[F.coalesce(x, zero).alias(x) for x in columns])
    total = got.agg(*[F.coalesce(F.sum(x), zero).alias(x) for x in columns]).select(F.lit("TOTAL").alias("statement_month"), *columns)
    both = got.unionByName(total)
    payroll = sum((F.col(p) for p in pay), F.lit(0).cast("decimal(18,2)"))
    external = F.col("total_bank_cash_in") - F.col("excluded_internal_cash_in")
    return both.select(
        "statement_month", *[_d(F.col(x)).alias(x) for x in columns], _d(external).alias("external_cash_in"), _d(payroll).alias("payroll_total"), _d(F.col("total_bank_cash_in") - payroll).alias("payroll_vs_total_cash_in_diff"), _d(external - payroll).alias("payroll_vs_external_cash_in_diff"),
    )


def income_by_source(inflow: DataFrame) -> DataFrame:
    return inflow.groupBy("statement_month", "income_source").agg(_d(F.sum("amount")).alias("amount"), F.count("*").alias("transaction_count"))


def income_line_items(inflow: DataFrame) -> DataFrame:
    rows = inflow.select("statement_month", "account_key", "transaction_date", "description", _d(F.col("amount")).alias("amount"), "income_source", "is_internal_inflow")
    return rows.orderBy("statement_month", F.desc("amount"), "account_key", "description")


def all_stats(rows: DataFrame, coverage: DataFrame, household: c.Household = c.HOUSEHOLD, words: DataFrame | None = None) -> dict[str, DataFrame]:
    """The batch's datasets, each lazy; persist rows where several are written.  words: wording() of the rows, if it is there already.

    The calendar and the account-months, accounts times months, are written at once: all datasets ask them what counts.
    """
    words = wording(rows, household) if words is None else words
    full = full_rows(rows, written(calendar(coverage), "calendar"))
    months = written(account_month(full), "account-months")
    credit = credit_by_month(months)
    done = complete_months(credit)
    spend = spend_rows(full, done, words)
    cards = card_spend(spend)
    inflow = inflows(full, done, words)
    return {
        "account_month": months, "account_summary": account_summary(months), "monthly_total": monthly_total(full, months), "credit_expenses_by_month": credit, "credit_summary": credit_summary(credit, months), "totals": totals(months),
        "category_summary": category_summary(cards, done), "category_by_month": category_by(cards, "statement_month"), "categorized_line_items": spend_line_items(cards),
        "all_spend_summary": category_summary(spend, done), "all_spend_by_month": category_by(spend, "statement_month"), "all_spend_by_source": category_by(spend, "spend_source"), "all_spend_line_items": spend_line_items(spend), "all_spend_totals": spend_totals(spend, done),
        "income_by_month": income_check(inflow, done, household), "income_by_source": income_by_source(inflow), "income_line_items": income_line_items(inflow),
    }
