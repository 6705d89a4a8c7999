from pyspark.sql import functions as F

from granary.functions import classify as c
from granary.functions import text as t


def one(spark, column, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(column).collect()]


def test_title_case_is_pythons(spark):
    values = ["T&T 5TH AVE", "o'neil-smith", "ÉCOLE", "A"]
    assert one(spark, t.title_case(F.col("x")), *values) == [v.title() for v in values]


def test_normalize_and_amounts(spark):
    assert one(spark, t.normalize_text(F.col("x")), "  a &amp;  b ", None) == ["a & b", ""]
    assert one(spark, t.full_unescape(F.col("x")), "&eacute;&hearts;", None) == ["é♥", None]
    assert one(spark, t.parse_amount(F.col("x")), "-$1,234.50", "CR 12", "none", None) == [-1234.5, 12.0, 0.0, 0.0]
    assert one(spark, t.strict_amount(F.col("x")), "0. 00", "1,2", None) == [0.0, None, None]
    assert one(spark, t.money_text(F.col("x").cast("decimal(18,2)")), "12.50", "-100", "10000000") == ["12.5", "-100.0", "10000000.0"]
    assert one(spark, t.url_decode(F.col("x")), "a%20b+c", "100%") == ["a b+c", "100%"]


def test_haystack_strips_prefixes_until_none_is_left(spark):
    assert one(spark, t.haystack(F.col("x")), "visa debit sq *coffee bar #12", "uber trip store 44", "shop 416-555-1234 loc 9") == ["coffee bar", "uber trip", "shop"]


def test_short_keywords_need_word_boundaries(spark):
    df = spark.createDataFrame([("hm 12",), ("rhythm",), ("shoppers drug mart hm",), ("",)], "x string")
    got = [r[0] for r in df.select(c.match_rule("x")["keyword"]).collect()]
    assert got == ["hm", None, "shoppers drug mart", None]


def test_flow_ladder(spark):
    df = spark.createDataFrame([("e-transfer received", 5.0, "bank_account"), ("visa payment", 5.0, "credit_card"), ("x refund", 5.0, "credit_card"), ("late fee", 5.0, "credit_card"), ("shop", -5.0, "credit_card"), ("shop", 5.0, "bank_account")], "x string, a double, s string")
    got = [r[0] for r in df.select(c.flow_type(F.col("x"), F.col("a"), F.col("s"))).collect()]
    assert got == ["Income", "Internal Transfer", "Refund", "Fees", "Credit", "Income"]
