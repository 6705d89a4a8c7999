"""Many rules by an index of q-grams, against the array that is scanned."""

import random

from pyspark.sql import functions as F

from granary.functions import classify as c
from granary.operators import rules as ru
from granary.plans.rebuild import enrich
from granary.queries import ordered_ledger

SF = "/root/testdata/sf0.001"
SCHEMA = "pos long, keyword string, category string, necessity string, beneficiary string"


def made(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé&*. ", k=rng.choice([1, 2, 3, 3, 4, 6, 9]))).strip() for _ in range(n)]
    return [{"keyword": w, "category": rng.choice(["Home", "Travel"]), "necessity": "Auto", "beneficiary": str(i)} for i, w in enumerate(words) if w]


def test_the_index_gives_what_the_array_gives(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdeé&*.  ", k=rng.randrange(0, 40))) for _ in range(400)] + ["a", "ab", "", "xyz", None]
    df = spark.createDataFrame([(t,) for t in dict.fromkeys(texts)], "t string")
    rules = made(1, 500)
    want = {r["t"]: r["found"] for r in df.withColumn("found", c.match_rule("t", rules)).collect()}
    listed = spark.createDataFrame([(i, *[r[f] for f in ru.FIELDS]) for i, r in enumerate(rules)], SCHEMA)
    got = {r["t"]: r["found"] for r in ru.match_rules(df, "t", listed, "found").collect()}
    assert got == want and sum(v is not None for v in got.values()) > 100
    assert {r["found"] for r in ru.match_rules(df, "t", listed.limit(0), "found").collect()} == {None}


def test_fifty_thousand_rules_classify_the_ledger(spark):
    rng = random.Random(5)
    many = [{"keyword": "".join(rng.choices("klmnopqrstu", k=8)), "category": "Travel", "necessity": "Auto", "beneficiary": "Auto"} for _ in range(50_000)]
    few = [{"keyword": "netflix", "category": "Home", "necessity": "Essential", "beneficiary": "Child"}, {"keyword": "tim hortons", "category": "Travel", "necessity": "Auto", "beneficiary": "Auto"}]
    raw = ordered_ledger(spark, SF).where("account_label < 'acct-0020'")
    columns = ["tx_ref", "category", "necessity", "beneficiary", "matched_keyword"]
    plain = lambda df: sorted(map(tuple, df.select(*columns).collect()))
    got = plain(enrich(raw, [*many, *few]))
    assert got == plain(enrich(raw, few)) and sum(r[4] == "netflix" for r in got) > 5
    assert enrich(raw, [*many, *few]).where(F.col("merchant").isNull()).count() == 0


def test_wording_is_looked_at_once_for_each_description(spark):
    """Rows join what their text says, null texts too; no word is looked up for a row (before, all flow words were)."""
    import datetime

    from granary.plans.rebuild import enrich

    rows = [(1, None), (2, "UBER* TRIP"), (3, " uber*  TRIP"), (4, "PAYROLL DEPOSIT EMPLOYERA"), (5, "CREDIT CARD PAYMENT"), (6, "SHOPPERS REFUND"), (7, "MONTHLY SERVICE FEE")]
    schema = "tx_ref long, description string, statement_id string, statement_type string, account_last4 string, account_label string, owner string, transaction_date date, reference string, amount decimal(18,2)"
    import decimal

    raw = spark.createDataFrame([(n, d, "s", "credit_card", "1", "a", "o", datetime.date(2024, 1, 2), "", decimal.Decimal("5.00")) for n, d in rows], schema)
    for full in (False, True):
        df = enrich(raw, full_html=full)
        got = {r["tx_ref"]: r for r in df.collect()}
        assert [got[n]["flow_type"] for n, _ in rows] == ["Expense", "Expense", "Expense", "Income", "Internal Transfer", "Refund", "Fees"]
        assert (got[1]["description"], got[3]["description"], got[3]["merchant"]) == ("", "uber* TRIP", got[2]["merchant"])
        assert got[5]["is_internal_candidate"] and not got[2]["is_internal_candidate"] and got[4]["category"] == "Salary & EI"
        plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "payroll" not in plan and "visa" not in plan and "arrow" not in plan
