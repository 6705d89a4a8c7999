"""The dashboard: named lazy datasets over three frames, scope, filtered and expense."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import fixed
from granary.operators.filters import Filters, apply_filters, hard_cash_out, needs_review, true_cash_in
from granary.sources.storage import written

WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def money(c: Column) -> Column:
    return c.cast("double")


def grouped(df: DataFrame, keys: list[str], value: str = "expense_amount") -> DataFrame:
    """Sums by keys; rows with a null key stay out."""
    known = df
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    return known.groupBy(*keys).agg(F.sum(value).alias("value"))


def ranked(df: DataFrame, keys: list[str], top: int | None = None, value: str = "expense_amount") -> DataFrame:
    """Sums by keys, largest first, ties by key; with top a TakeOrderedAndProject."""
    out = grouped(df, keys, value).orderBy(F.desc("value"), *keys)
    return (out.limit(top) if top else out).withColumn("value", money(F.col("value")))


def by_month(df: DataFrame, keys: list[str], top: int | None = None, value: str = "expense_amount") -> DataFrame:
    """Sums by month and keys; with top the largest of each month (WindowGroupLimit before the shuffle)."""
    out = grouped(df, ["month", *keys], value)
    if top:
        w = Window.partitionBy("month").orderBy(F.desc("value"), *keys)
        out = out.withColumn("n", F.row_number().over(w)).where(F.col("n") <= top).drop("n")
    return out.withColumn("value", money(F.col("value")))


def overview(scope: DataFrame, filtered: DataFrame) -> DataFrame:
    """All scalars in one row: one pass over scope and one over filtered, joined as single rows."""
    matched = F.col("internal_match_status") == "Matched"
    a = scope.agg(
        F.count_distinct("statement_id").alias("statement_count"), F.count_distinct("account_label").alias("account_count"), F.count_distinct("owner").alias("owner_count"),
        money(F.sum(F.when(F.col("cash_flow_amount") > 0, F.col("cash_flow_amount")))).alias("cash_in_total"), money(F.sum(F.when(F.col("is_internal"), F.abs("cash_flow_amount"))) / 2).alias("internal_total"),
        F.count_distinct(F.when(matched, F.col("match_id"))).alias("matched_internal_pairs"), F.count_if(F.col("internal_match_status") == "Unmatched").alias("unmatched_internal_rows"),
    )
    spent = F.when(F.col("expense_amount") > 0, F.col("expense_amount"))
    b = filtered.agg(
        F.count("*").alias("transaction_count"), money(F.sum(spent)).alias("expense_total"), F.date_format(F.min("transaction_date"), "yyyy-MM-dd").alias("date_start"), F.date_format(F.max("transaction_date"), "yyyy-MM-dd").alias("date_end"),
        F.greatest(F.lit(1), F.count_distinct(F.when(spent.isNotNull(), F.col("month")))).alias("expense_month_count"), F.round(F.sum(spent) / F.count(spent), 2).cast("double").alias("avg_expense_transaction"),
    )
    top = grouped(filtered.where("expense_amount > 0"), ["category"]).orderBy(F.desc("value"), "category").limit(1).select(F.col("category").alias("top_category"), money(F.col("value")).alias("top_category_amount"))
    return a.crossJoin(b).join(top, F.lit(True), "left")


def cash_ledger(filtered: DataFrame, out: bool) -> DataFrame:
    cols = ["transaction_date", "owner", "account_label", "merchant", "description", "category", "flow_type", "amount", "cash_flow_amount"]
    rows = filtered.where(hard_cash_out() if out else true_cash_in()).select(*cols)
    return rows.orderBy(F.desc_nulls_last("transaction_date"), *[c for c in cols if c != "transaction_date"]).limit(fixed.LEDGER_CAP)


def cash_totals(filtered: DataFrame) -> DataFrame:
    # the wording is looked at once for each distinct text, not for each row and sum
    same = ["description", "merchant", "flow_type", "category", "is_internal", F.signum("cash_flow_amount").alias("sign")]
    each = filtered.groupBy(*same).agg(F.sum("cash_flow_amount").alias("cash"), F.count("*").alias("n")).withColumnRenamed("sign", "cash_flow_amount")
    i, o = true_cash_in(), hard_cash_out()
    total = lambda c, v: F.coalesce(F.sum(F.when(c, F.col(v))), F.lit(0))
    got = each.agg(
        money(total(i, "cash")).alias("cash_in_ledger_total"), money(total(o, "cash")).alias("cash_out_ledger_total"),
        total(i, "n").cast("long").alias("cash_in_ledger_count"), total(o, "n").cast("long").alias("cash_out_ledger_count"),
    )
    cap = lambda c: F.least(F.col(c), F.lit(fixed.LEDGER_CAP))
    return got.withColumns({"cash_in_ledger_shown": cap("cash_in_ledger_count"), "cash_out_ledger_shown": cap("cash_out_ledger_count")})


def weekday_dense(expense: DataFrame) -> DataFrame:
    days = expense.sparkSession.createDataFrame(list(enumerate(WEEKDAYS)), "day_index int, weekday string")
    sums = grouped(expense, ["weekday"])
    return days.join(sums, "weekday", "left").select("day_index", "weekday", money(F.coalesce("value", F.lit(0))).alias("value")).orderBy("day_index")


def statement_breakdown(filtered: DataFrame) -> DataFrame:
    got = filtered.where("statement_id is not null and account_label is not null").groupBy("statement_id", "account_label").agg(F.sum("expense_amount").alias("value"), F.count("expense_amount").alias("count"))
    return got.orderBy(F.desc("value"), "statement_id", "account_label").withColumn("value", money(F.col("value")))


def sankey_links(expense: DataFrame, monthly: bool = False) -> DataFrame:
    """Links owner to beneficiary and beneficiary to category; nodes are numbered by (layer, name), so that equal names do not meet."""
    m = ["month"] if monthly else []
    one = grouped(expense, [*m, "owner", "beneficiary"]).select(*m, F.lit(0).alias("layer"), F.col("owner").alias("source_name"), F.col("beneficiary").alias("target_name"), "value")
    two = grouped(expense, [*m, "beneficiary", "category"]).select(*m, F.lit(1).alias("layer"), F.col("beneficiary").alias("source_name"), F.col("category").alias("target_name"), "value")
    return one.unionByName(two).withColumn("value", money(F.col("value")))


def sankey_nodes(expense: DataFrame) -> DataFrame:
    layers = [expense.select(F.lit(i).alias("layer"), F.col(c).alias("name")).where(F.col(c).isNotNull()).distinct() for i, c in enumerate(("owner", "beneficiary", "category"))]
    nodes = layers[0].unionByName(layers[1]).unionByName(layers[2])
    # one row for each name of a taxonomy or owner
    return nodes.withColumn("node", F.row_number().over(Window.orderBy("layer", "name")) - 1)


def waterfall(expense: DataFrame, top: int = 6) -> DataFrame:
    """The top categories, and one row for the rest if it is positive."""
    w = Window.orderBy(F.desc("value"), "category")
    sums = grouped(expense, ["category"]).withColumn("n", F.row_number().over(w))
    label = F.when(F.col("n") <= top, F.col("category")).otherwise("Other Categories")
    out = sums.groupBy((F.col("n") > top).alias("rest"), label.alias("label")).agg(F.sum("value").alias("value"), F.min("n").alias("rank"))
    return out.where("not rest or value > 0").orderBy("rank").select("label", money(F.col("value")).alias("value"))


def matched_transfers(scope: DataFrame) -> DataFrame:
    """The two earliest legs of each pair that has two in scope."""
    rows = scope.where("internal_match_status = 'Matched'")
    leg = F.struct(F.coalesce(F.date_format("transaction_date", "yyyy-MM-dd"), F.lit("9999")).alias("day"), "ingest_pos", "account_label", "description", F.abs("cash_flow_amount").alias("amount"), F.coalesce("matched_keyword", F.lit("")).alias("tag"))
    legs = rows.groupBy("match_id").agg(F.sort_array(F.collect_list(leg)).alias("legs")).where(F.size("legs") >= 2)
    a, b = F.col("legs")[0], F.col("legs")[1]
    return legs.select(
        "match_id", a["day"].alias("date_left"), b["day"].alias("date_right"), a["account_label"].alias("account_left"), b["account_label"].alias("account_right"),
        a["description"].alias("description_left"), b["description"].alias("description_right"), money(a["amount"]).alias("amount"), a["tag"].alias("tag_left"), b["tag"].alias("tag_right"),
    ).orderBy("match_id")


def unmatched_internal(scope: DataFrame) -> DataFrame:
    cols = ["transaction_date", "account_label", "owner", "description", "value"]
    rows = scope.where("internal_match_status = 'Unmatched'").withColumn("value", money(F.col("cash_flow_amount"))).select(*cols)
    return rows.orderBy(F.desc_nulls_last("transaction_date"), *cols[1:]).limit(fixed.UNMATCHED_CAP)


RECENT = "transaction_date owner account_label merchant description category necessity beneficiary flow_type amount expense_amount internal_match_status tx_key category_source".split()


def recent(filtered: DataFrame, limit: int = fixed.RECENT_CAP) -> DataFrame:
    rows = filtered.select(*RECENT).orderBy(F.desc_nulls_last("transaction_date"), *[c for c in RECENT if c != "transaction_date"]).limit(limit)
    return rows.withColumns({"amount": money(F.col("amount")), "expense_amount": money(F.col("expense_amount"))})


REVIEW = "tx_key transaction_date owner account_label merchant description amount expense_amount category necessity beneficiary flow_type category_source matched_keyword".split()


def category_review(filtered: DataFrame) -> DataFrame:
    rows = filtered.where(needs_review()).select(*REVIEW).orderBy(F.abs("expense_amount").desc(), *REVIEW).limit(fixed.REVIEW_CAP)
    return rows.withColumns({"amount": money(F.col("amount")), "expense_amount": money(F.col("expense_amount"))})


def other_uncategorized(scope: DataFrame) -> DataFrame:
    cols = ["transaction_date", "account_label", "description", "amount", "merchant"]
    rows = scope.where("category = 'Other' and not coalesce(is_internal, false)").select(*cols)
    return rows.orderBy(F.abs("amount").desc(), *cols).limit(fixed.OTHER_CAP).withColumn("amount", money(F.col("amount")))


def internal_stats(scope: DataFrame) -> DataFrame:
    d, matched = F.col("internal_detection"), F.col("internal_match_status") == "Matched"
    return scope.agg(
        F.count_if(d == "keyword").alias("rows_keyword"), F.count_if(d == "paired").alias("rows_paired"), F.count_if(d == "unmatched_candidate").alias("rows_unmatched_candidate"),
        F.count_distinct(F.when(matched, F.col("match_id"))).alias("pair_count"), F.count_distinct(F.when(matched & (F.col("matched_keyword") == "amount+timing"), F.col("match_id"))).alias("pairs_amount_timing"),
    )


def filter_values(base: DataFrame) -> DataFrame:
    """The sorted distinct values of each dimension: small sets, one pass."""
    dims = {"owners": "owner", "accounts": "account_label", "categories": "category", "necessities": "necessity", "beneficiaries": "beneficiary", "months": "month"}
    return base.agg(*[F.sort_array(F.collect_set(c)).alias(n) for n, c in dims.items()])


def trailing_mean(monthly: DataFrame, months: int = 3) -> DataFrame:
    """The mean of up to three present months up to each; none of fewer than three months in all."""
    # one row a month
    whole = Window.partitionBy()
    w = Window.orderBy("month").rowsBetween(-(months - 1), 0)
    got = monthly.withColumn("n", F.count("*").over(whole)).withColumn("trailing", F.round(F.avg("value").over(w), 6))
    return got.where(F.col("n") >= months).select("month", "value", "trailing")


def sparkline(monthly: DataFrame, points: int = 10) -> DataFrame:
    """The last months, scaled to 0..1 by their smallest and largest value."""
    last = monthly.orderBy(F.desc("month")).limit(points)
    w = Window.partitionBy()
    low, high = F.min("value").over(w), F.max("value").over(w)
    return last.select("month", "value", F.round(F.when(high > low, (F.col("value") - low) / (high - low)).otherwise(F.lit(0.5)), 6).alias("scaled"))


def hierarchy(expense: DataFrame, levels: list[str]) -> DataFrame:
    """Every level of a hierarchy with its sum, root included; depth 0 is the root."""
    known = expense
    for k in levels:
        known = known.where(F.col(k).isNotNull())
    depth = sum(((1 - F.grouping(k)) for k in levels[1:]), 1 - F.grouping(levels[0]))
    return known.rollup(*levels).agg(F.sum("expense_amount").alias("value"), depth.cast("int").alias("depth")).withColumn("value", money(F.col("value")))


def relabel_months(monthly: DataFrame, label: str, mode: str = "scope", month: str | None = None, top: int | None = None) -> DataFrame:
    """Sums by label over monthly rows: all of them, their mean by month, or one month."""
    rows = monthly.where(F.col("month") == month) if mode == "month" else monthly
    total = F.sum(F.col("value").cast("decimal(18,2)"))
    if mode == "avg":
        months = monthly.agg(F.greatest(F.lit(1), F.count_distinct("month")).alias("months"))
        out = rows.groupBy(label).agg(total.alias("t")).crossJoin(F.broadcast(months)).select(label, (F.col("t").cast("double") / F.col("months")).alias("value"))
    else:
        out = rows.groupBy(label).agg(total.cast("double").alias("value"))
    out = out.orderBy(F.desc("value"), label)
    return out.limit(top) if top else out


def dense_matrix(expense: DataFrame, rows: str, columns: str) -> DataFrame:
    """Every pair of a row and a column value, 0 where nothing was spent."""
    a, b = (expense.where(F.col(c).isNotNull()).select(c).distinct() for c in (rows, columns))
    # two dimension lists, not the ledger
    return a.crossJoin(F.broadcast(b)).join(grouped(expense, [rows, columns]), [rows, columns], "left").select(rows, columns, money(F.coalesce("value", F.lit(0))).alias("value"))


def frames(txn: DataFrame, f: Filters) -> tuple[DataFrame, DataFrame, DataFrame]:
    filtered = apply_filters(txn, f)
    return apply_filters(txn, replace(f, include_internal=True)), filtered, filtered.where("expense_amount > 0")


SIMPLE = {
    "category_breakdown": ["category"], "necessity_breakdown": ["necessity"], "beneficiary_breakdown": ["beneficiary"], "owner_breakdown": ["owner"], "account_breakdown": ["account_label"],
    "owner_beneficiary_breakdown": ["owner", "beneficiary"],
}
MONTHLY = {
    "monthly_category_breakdown": ["category"], "monthly_necessity_breakdown": ["necessity"], "monthly_beneficiary_breakdown": ["beneficiary"], "monthly_owner_breakdown": ["owner"],
    "monthly_account_breakdown": ["account_label"], "monthly_weekday_breakdown": ["weekday"], "monthly_owner_beneficiary_breakdown": ["owner", "beneficiary"], "monthly_expenses": [],
}
TOP = {"merchant_breakdown": (["merchant"], 12), "treemap_breakdown": (["necessity", "category", "merchant"], 80), "sunburst_breakdown": (["beneficiary", "category", "merchant"], 100)}
MONTHLY_TOP = {"monthly_merchant_breakdown": (["merchant"], 20), "monthly_treemap_breakdown": (["necessity", "category", "merchant"], 80), "monthly_sunburst_breakdown": (["beneficiary", "category", "merchant"], 100)}


def siblings(expense: DataFrame) -> dict[str, DataFrame]:
    """The datasets of SIMPLE, MONTHLY, TOP and MONTHLY_TOP from one pass over expense: grouping sets, whose sums are written once and split by their grouping id."""
    keys = {n: k for n, k in SIMPLE.items()} | {n: ["month", *k] for n, k in MONTHLY.items()} | {n: k for n, (k, _) in TOP.items()} | {n: ["month", *k] for n, (k, _) in MONTHLY_TOP.items()}
    columns = list(dict.fromkeys(c for k in keys.values() for c in k))
    sets = list(dict.fromkeys(tuple(k) for k in keys.values()))
    sums = expense.groupingSets([[F.col(c) for c in k] for k in sets], *[F.col(c) for c in columns]).agg(F.sum("expense_amount").alias("value"), F.grouping_id().alias("gs_id"))
    sums = written(sums, "siblings")

    def one(k: list[str]) -> DataFrame:
        # a bit for each column that is not grouped by, the first column's the highest; rows with a null key stay out
        number = sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in k)
        return sums.where((F.col("gs_id") == number) & ~F.greatest(F.lit(False), *[F.col(c).isNull() for c in k])).select(*k, "value")

    out = {}
    for n, k in keys.items():
        df = one(k)
        if n in TOP or n in SIMPLE:
            df = df.orderBy(F.desc("value"), *k)
            df = df.limit(TOP[n][1]) if n in TOP else df
        elif n in MONTHLY_TOP:
            w = Window.partitionBy("month").orderBy(F.desc("value"), *k[1:])
            df = df.withColumn("n", F.row_number().over(w)).where(F.col("n") <= MONTHLY_TOP[n][1]).drop("n")
        out[n] = df.withColumn("value", money(F.col("value")))
    return out


def internal_review(scope: DataFrame) -> dict[str, DataFrame]:
    """What a reader of the pairing looks at: its counts, the first pairs, the latest candidates without a partner, and what no rule names."""
    return {
        "internal_review_stats": internal_stats(scope), "internal_review_matched": matched_transfers(scope).limit(fixed.MATCHED_CAP),
        "internal_review_unmatched": unmatched_internal(scope), "internal_review_other": other_uncategorized(scope),
    }


def dashboard(txn: DataFrame, f: Filters = Filters(), coverage: DataFrame | None = None, reconciled: DataFrame | None = None) -> dict[str, DataFrame]:
    """All datasets of the dashboard, each lazy; those that only differ by their keys share one written pass.  Persist txn where several of the others are collected.

    coverage: months held against expectations (sources.files.statement_coverage).  reconciled: an audit's statement_reconciliation.  With them the dashboard
    has statement_coverage, in order of months, and statement_totals_check.
    """
    scope, filtered, expense = frames(txn, f)
    out = {
        "overview": overview(scope, filtered), "filters": filter_values(txn), "daily_expenses": grouped(expense.withColumn("day", F.date_format("transaction_date", "yyyy-MM-dd")), ["day"]).withColumn("value", money(F.col("value"))),
        "flow_breakdown": ranked(filtered, ["flow_type"], value="cash_flow_amount"), "monthly_flow_breakdown": by_month(filtered, ["flow_type"], value="cash_flow_amount"), "weekday_breakdown": weekday_dense(expense),
        "statement_breakdown": statement_breakdown(filtered), "sankey_links": sankey_links(expense), "sankey_nodes": sankey_nodes(expense), "monthly_sankey": sankey_links(expense, True), "waterfall": waterfall(expense),
        "matched_transfers": matched_transfers(scope), "unmatched_internal": unmatched_internal(scope), "recent_transactions": recent(filtered), "cash_in_transactions": cash_ledger(filtered, False), "cash_out_transactions": cash_ledger(filtered, True),
        "cash_totals": cash_totals(filtered), "category_review": category_review(filtered), "other_uncategorized": other_uncategorized(scope), "internal_stats": internal_stats(scope),
    }
    if coverage is not None:
        out["statement_coverage"] = coverage.orderBy("month")
    if reconciled is not None:
        out["statement_totals_check"] = reconciled.agg(F.count_if("reconcile_ok").alias("ok_count"), F.count("*").alias("file_count"))
    return out | internal_review(scope) | siblings(expense)
