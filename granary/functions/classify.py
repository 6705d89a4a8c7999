"""How money flows, what it was spent on, and for whom: ordered ladders as CASE expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions import fixed
from granary.functions.fixed import AUTO, lines, words
from granary.functions.text import collapse, has_any, normalize_text


@dataclass(frozen=True)
class Household:
    """Who the ledger belongs to: configuration, not code."""

    child: str = "Child"
    #: (needle in the owner's name, beneficiary), in order.
    members: tuple[tuple[str, str], ...] = (("membera", "MemberA"), ("memberb", "MemberB"))
    #: (text of the payroll line, employer), in order.
    employers: tuple[tuple[str, str], ...] = (("payroll deposit employera", "EmployerA"), ("payroll deposit employerb", "EmployerB"))
    own_names: tuple[str, ...] = field(default=())


HOUSEHOLD = Household()


def plain(description: Column, full: bool = False) -> Column:
    """The lower-case normalised text that the functions below look words up in.  Bind it to a column first: they use it often."""
    return F.lower(normalize_text(description, full))


def worded_flow(text: Column) -> Column:
    """The flow that the wording alone decides, else null."""
    return (
        F.when(has_any(text, words(fixed.RECEIPT_MARKERS)), "Income")
        .when(has_any(text, words(fixed.TRANSFER_WORDS)), "Internal Transfer")
        .when(has_any(text, words(fixed.REFUND_WORDS)), "Refund")
        .when(has_any(text, words(fixed.PAY_WORDS) + words(fixed.OTHER_INCOME_WORDS)), "Income")
        .when(has_any(text, words(fixed.FEE_WORDS)), "Fees")
    )


def signed_flow(worded: Column, amount: Column, statement_type: Column) -> Column:
    """The worded flow, or what the sign says on this kind of statement."""
    card = statement_type == "credit_card"
    return F.when(worded.isNotNull(), worded).when(card, F.when(amount > 0, "Expense").otherwise("Credit")).otherwise(F.when(amount < 0, "Expense").otherwise("Income"))


def flow_type(text: Column, amount: Column, statement_type: Column) -> Column:
    return signed_flow(worded_flow(text), amount, statement_type)


def worded_candidate(text: Column) -> Column:
    """Whether the wording speaks of an own transfer; what flows as one is a candidate all the same."""
    return F.when(has_any(text, words(fixed.RETAIL_DEBIT_MARKERS)), False).otherwise(has_any(text, words(fixed.INTERNAL_PHRASES)))


def has_timing_hint(text: Column) -> Column:
    return has_any(text, words(fixed.TIMING_HINTS))


def cash_flow_amount(amount: Column, statement_type: Column) -> Column:
    return F.when(statement_type == "credit_card", -amount).otherwise(amount)


def expense_amount(amount: Column, statement_type: Column, flow: Column, is_internal: Column) -> Column:
    zero = F.lit(0).cast("decimal(18,2)")
    return (
        F.when(is_internal, zero)
        .when(flow.isin("Income", "Refund", "Credit"), zero)
        .when(flow == "Fees", F.abs(amount))
        .when(statement_type == "credit_card", F.greatest(amount, zero))
        .otherwise(F.greatest(-amount, zero))
    )


def necessity_of(category: Column) -> Column:
    out = None
    for necessity, categories in lines(fixed.NECESSITY_OF):
        hit = category.isin(categories)
        out = F.when(hit, necessity) if out is None else out.when(hit, necessity)
    return out.otherwise("Discretionary")


def beneficiary_of(owner: Column, category: Column, household: Household = HOUSEHOLD) -> Column:
    name = F.lower(owner)
    out = F.when(category == "Kids & Family", household.child).when(category.isin(words(fixed.SHARED_CATEGORIES)), "Shared")
    for needle, member in household.members:
        out = out.when(name.contains(needle), member)
    return out.otherwise("Shared")


def by_length(rules: list[dict[str, str]], key: str = "keyword") -> list[dict[str, str]]:
    """Longest keyword first; equally long ones keep their order."""
    return sorted(rules, key=lambda r: -len(r[key]))


def _literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def match_rule(text: str, rules: list[dict[str, str]] | None = None) -> Column:
    """struct(keyword, category, necessity, beneficiary) of the best rule, null without one; text names a column of plain texts.

    The rules are one literal array in order of precedence, and its first hit is taken: no join, and code of constant
    size however many rules there are.  Keywords of one or two characters have to stand as words of their own.
    """
    ordered = by_length(fixed.category_rules() if rules is None else rules)
    if not ordered:
        return F.expr("cast(null as struct<keyword: string, category: string, necessity: string, beneficiary: string>)")
    fields = ("keyword", "category", "necessity", "beneficiary")
    table = ", ".join("named_struct(" + ", ".join(f"'{f}', {_literal(r[f])}" for f in fields) + ")" for r in ordered)
    word = r"concat('(?U)(?<!\\w)\\Q', r.keyword, '\\E(?!\\w)')"
    return F.expr(f"case when {text} <> '' then get(filter(array({table}), r -> contains({text}, r.keyword) and (length(r.keyword) > 2 or {text} rlike {word})), 0) end")


def canonical_merchant(hay: str, aliases: list[tuple[str, str]] | None = None) -> Column:
    """The label of the longest alias in the haystack, a column; user aliases come before equally long ones."""
    pairs = sorted(fixed.merchant_aliases() if aliases is None else [*aliases, *fixed.merchant_aliases()], key=lambda p: -len(p[0]))
    table = ", ".join(f"named_struct('needle', {_literal(n)}, 'label', {_literal(lab)})" for n, lab in pairs)
    return F.expr(f"case when {hay} <> '' then get(filter(array({table}), a -> contains({hay}, a.needle)), 0).label end")


def bare_name(description: Column) -> Column:
    """An upper-case description without long numbers and phone numbers, for merchants without an alias."""
    raw = F.regexp_replace(F.regexp_replace(F.upper(description), r"\b\d{10,}\b", ""), r"\b\d{3}-\d{3}-\d{4}\b", "")
    return F.regexp_replace(collapse(raw), r"^[ -]+|[ -]+$", "")


def is_salary(text: Column) -> Column:
    return has_any(text, words(fixed.PAY_WORDS))


def resolve_targets(owner: Column, category: Column, necessity: Column, beneficiary: Column, household: Household = HOUSEHOLD) -> tuple[Column, Column]:
    """Auto and unknown values of necessity and beneficiary, resolved."""
    known_n = necessity.isin([n for n in words(fixed.NECESSITIES) if n != AUTO])
    known_b = beneficiary.isin([household.child if b == "Child" else b for b in words(fixed.BENEFICIARIES) if b != AUTO])
    return F.when(known_n, necessity).otherwise(necessity_of(category)), F.when(known_b, beneficiary).otherwise(beneficiary_of(owner, category, household))


def worded_targets(text: Column, rule: Column, household: Household = HOUSEHOLD) -> dict[str, Column]:
    """What a description and its rule alone say: ruled targets, where en_for is null if the owner decides, and the category of income."""
    ruled = F.coalesce(rule["category"], F.lit("Other"))
    return {
        "en_income": F.when(is_salary(text), "Salary & EI").otherwise("Income"), "en_category": ruled, "en_keyword": F.coalesce(rule["keyword"], F.lit("")),
        "en_necessity": F.when(rule["necessity"] != AUTO, rule["necessity"]).otherwise(necessity_of(ruled)),
        "en_for": F.when(rule["beneficiary"] != AUTO, rule["beneficiary"]).when(ruled == "Kids & Family", household.child).when(ruled.isin(words(fixed.SHARED_CATEGORIES)), "Shared"),
    }


def classified(owner: Column, flow: Column, household: Household = HOUSEHOLD) -> dict[str, Column]:
    """category, necessity, beneficiary and matched_keyword of a row that has the columns of worded_targets()."""
    other = beneficiary_of(owner, F.lit("Other"), household)
    return {
        "category": F.when(flow.isin("Internal Transfer", "Refund", "Fees"), flow).when(flow == "Income", F.col("en_income")).otherwise(F.col("en_category")),
        "necessity": F.when(flow == "Internal Transfer", "Savings & Transfers").when(flow.isin("Refund", "Income"), flow).when(flow == "Fees", "Fixed Bills").otherwise(F.col("en_necessity")),
        "beneficiary": F.when(flow.isin("Internal Transfer", "Income"), "Shared").when(flow.isin("Refund", "Fees"), other).otherwise(F.coalesce(F.col("en_for"), beneficiary_of(owner, F.lit(None).cast("string"), household))),
        "matched_keyword": F.when(flow == "Internal Transfer", "internal transfer").when(flow.isin("Refund", "Income", "Fees"), "").otherwise(F.col("en_keyword")),
    }


# --- batch statistics ---


def _flat(description: Column) -> Column:
    return F.lower(collapse(description))


def spend_group(description: Column) -> Column:
    text = _flat(description)
    lessons = has_any(text, words(fixed.LESSON_WORDS))
    out = F.when(text.contains(fixed.SENT_TRANSFER), F.when(lessons, "Kids Education & Activities").otherwise("Personal E-Transfers"))
    for group, needles in lines(fixed.SPEND_FIRST) + lines(fixed.SPEND_GROUPS):
        out = out.when(has_any(text, needles), group)
    return out.otherwise("Other / Review")


def is_own_transfer(description: Column, household: Household = HOUSEHOLD) -> Column:
    text = _flat(description)
    named = has_any(text, list(household.own_names)) if household.own_names else F.lit(False)
    return has_any(text, words(fixed.OWN_TRANSFER_MARKERS)) | (text.contains("online transfer sent") & named)


def is_internal_inflow(description: Column, household: Household = HOUSEHOLD) -> Column:
    return has_any(_flat(description), words(fixed.INTERNAL_INFLOW_MARKERS) + list(household.own_names))


def income_source(description: Column, household: Household = HOUSEHOLD) -> Column:
    text = _flat(description)
    out = None
    for needles, source in [([n], e) for n, e in household.employers] + [(n, s) for s, n in lines(fixed.INCOME_SOURCES)]:
        hit = has_any(text, needles)
        out = F.when(hit, source) if out is None else out.when(hit, source)
    return out.when(is_internal_inflow(description, household), "Internal Transfer In").otherwise("Other Inflow")


