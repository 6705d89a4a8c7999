"""Category rules matched by an index, for rule sets too long to be scanned for each text.

A keyword can only stand in a text that holds each of its q-grams.  Every rule is filed under one of
them, the one that the fewest texts hold; texts meet rules by equal q-grams, and only those pairs are tested.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Longer keywords are filed by so many characters.
GRAM = 3
#: Up to so many rules an array that is scanned is the quicker way.
ARRAY_RULES = 2_000
FIELDS = ("keyword", "category", "necessity", "beneficiary")


def _grams(text: str, sizes) -> str:
    """SQL for the distinct q-grams of a text column, of all given sizes."""
    each = [f"transform(sequence(1, greatest(1, length({text}) - {q - 1})), i -> substring({text}, i, {q}))" for q in sizes]
    return f"array_distinct(flatten(array({', '.join(each)})))"


def match_rules(texts: DataFrame, text: str, rules: DataFrame, name: str) -> DataFrame:
    """texts, whose column text has distinct values, with the best rule of each as struct ``name``, null without one.

    rules: pos (their order) and FIELDS, keywords in lower case.  The longest keyword wins, of equally long ones the first; keywords of one
    or two characters have to stand as words of their own; empty and null texts match none.
    """
    sizes = sorted({min(n, GRAM) for (n,) in rules.select(F.length("keyword")).distinct().collect() if n})
    if not sizes:
        return texts.withColumn(name, F.lit(None).cast("struct<keyword: string, category: string, necessity: string, beneficiary: string>"))
    grams = texts.where(F.col(text) != "").select(F.col(text).alias("mr_text"), F.explode(F.expr(_grams(text, sizes))).alias("mr_gram"))
    held = grams.groupBy("mr_gram").agg(F.count("*").alias("mr_texts"))
    own = F.expr(f"filter({_grams('keyword', range(1, GRAM + 1))}, g -> length(g) = least(length(keyword), {GRAM}))")
    filed = rules.where("keyword <> ''").select("pos", *FIELDS, F.explode(own).alias("mr_gram")).join(held, "mr_gram", "left")
    # a q-gram that no text holds rules the keyword out
    filed = filed.groupBy("pos", *FIELDS).agg(F.min(F.struct(F.coalesce("mr_texts", F.lit(0)).alias("n"), "mr_gram")).alias("at")).where("at.n > 0")
    filed = filed.select("pos", *FIELDS, F.col("at.mr_gram").alias("mr_gram"))
    word = F.expr(r"rlike(mr_text, concat('(?U)(?<!\\w)\\Q', keyword, '\\E(?!\\w)'))")
    met = grams.join(filed, "mr_gram").where(F.contains("mr_text", "keyword") & ((F.length("keyword") > 2) | word))
    best = met.groupBy("mr_text").agg(F.min_by(F.struct(*FIELDS), F.struct(-F.length("keyword"), "pos")).alias(name))
    return texts.join(best, F.col(text) == F.col("mr_text"), "left").drop("mr_text")
