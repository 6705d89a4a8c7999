"""The star-schema tables as a ledger: line items are transactions, customers accounts, nations owners."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.shipping import ship

DESCRIPTIONS = [
    "COSTCO WHOLESALE #123", "UBER* TRIP", "PAYROLL DEPOSIT EMPLOYERA", "E-TRANSFER SENT PIANO", "SHOPPERS DRUG MART", "INTERAC REFUND", "MONTHLY SERVICE FEE", None,
    "ATM WITHDRAWAL 0042", "CREDIT CARD PAYMENT", "MORTGAGE PAYMENT", "E-TRANSFER RECEIVED", "SQ *TIM HORTONS 555-123-4567", "NETFLIX.COM", "HM CA 12", "ONLINE BANKING TRANSFER - 4412",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger's raw rows: tx_ref, account, owner, date, description, reference, amount.

    Customers, nations and parts join by their keys; Spark broadcasts them under its size threshold.  Parts come first, so that only a
    line's few columns move for them, and rows of an order, then of a customer, lie together in the end.
    """
    line, orders, customer, nation, part = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation", "part"))
    turn = (F.col("l_orderkey") + F.col("l_linenumber")) % len(DESCRIPTIONS)
    said = F.element_at(F.array(*[F.upper("p_name") if d is None else F.lit(d) for d in DESCRIPTIONS]), (turn + 1).cast("int"))
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice", said.alias("said"))
    rows = rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    last4 = F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")
    kind = F.when(F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING"), "bank_account").when(F.col("c_mktsegment") == "MACHINERY", "credit_line").otherwise("credit_card")
    day = F.col("o_orderdate").cast("date")
    return rows.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tx_ref"),
        F.concat(F.lit("st-"), last4, F.lit("-"), F.date_format(day, "yyyyMM")).alias("statement_id"),
        kind.alias("statement_type"),
        last4.alias("account_last4"),
        F.concat(F.lit("acct-"), last4).alias("account_label"),
        F.when(kind == "credit_card", F.when(F.col("c_custkey") % 2 == 0, "visa").otherwise("mastercard")).when(kind == "credit_line", "credit_line").otherwise("chequing").alias("account_kind"),
        F.col("n_name").alias("owner"),
        day.alias("transaction_date"),
        F.col("said").alias("description"),
        F.when(F.col("l_linenumber") % 3 == 0, F.col("l_orderkey").cast("string")).otherwise("").alias("reference"),
        (F.when(F.col("l_returnflag") == "R", 1).otherwise(-1) * F.col("l_extendedprice").cast("decimal(18,2)")).cast("decimal(18,2)").alias("amount"),
    )
