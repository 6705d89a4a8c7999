"""What users ask to correct: overrides of single transactions, and rules for all that say the same; edits of many rules at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.fixed import AUTO
from granary.functions.text import normalize_text
from granary.operators.overrides import valid_rules

_S = T.StringType()
#: seq is the order of the items.
CORRECTION = T.StructType([T.StructField("seq", T.LongType())] + [T.StructField(n, _S) for n in ("tx_key", "category", "necessity", "beneficiary")] + [T.StructField("add_rule", T.BooleanType()), T.StructField("add_rule_keyword", _S)])
#: Keywords of fewer letters make no rule.
KEYWORD_LEAST = 2


def added_rules(items: DataFrame) -> DataFrame:
    """The rules that corrections add, in their order: of each keyword the first, with known values."""
    keyword = F.lower(normalize_text(F.col("add_rule_keyword")))
    asked = items.where(F.coalesce("add_rule", F.lit(False))).select("seq", keyword.alias("keyword"), F.coalesce("category", F.lit("Other")).alias("category"), *[F.coalesce(n, F.lit(AUTO)).alias(n) for n in ("necessity", "beneficiary")])
    asked = asked.where(F.length("keyword") >= KEYWORD_LEAST)
    first = asked.withColumn("n", F.row_number().over(Window.partitionBy("keyword").orderBy("seq"))).where("n = 1")
    return valid_rules(first, "seq").orderBy("seq").drop("seq")


def correction_overrides(items: DataFrame) -> DataFrame:
    """The overrides (seq, tx_key and targets) that corrections set; items without a key set none."""
    named = items.withColumn("tx_key", F.trim(F.coalesce("tx_key", F.lit("")))).where("tx_key <> ''")
    return named.select("seq", "tx_key", "category", *[F.coalesce(n, F.lit(AUTO)).alias(n) for n in ("necessity", "beneficiary")])


@dataclass(frozen=True)
class RuleFilter:
    """Rules that a search shows: text in any of their four fields, and equal targets; what is empty does not restrict."""

    text: str = ""
    category: str = ""
    necessity: str = ""
    beneficiary: str = ""

    def matches(self) -> Column:
        fields = ("keyword", "category", "necessity", "beneficiary")
        needle = self.text.strip().lower()
        found = F.lit(True)
        if needle:
            found = F.contains(F.lower(F.concat_ws("\n", *fields)), F.lit(needle)) if "\n" not in needle else F.lit(False)
        for name in fields[1:]:
            if value := getattr(self, name):
                found = found & (F.col(name) == value)
        return found


def edit_rules(rules: DataFrame, shown: RuleFilter, **values: str) -> DataFrame:
    """rules with new values of category, necessity or beneficiary for those that the filter shows; empty values change nothing."""
    unknown = set(values) - {"category", "necessity", "beneficiary"}
    if unknown:
        raise ValueError(f"rules have no {sorted(unknown)} to edit")
    hit = rules.withColumn("er_hit", shown.matches())
    return hit.withColumns({n: F.when(F.col("er_hit"), v).otherwise(F.col(n)) for n, v in values.items() if v}).drop("er_hit")
