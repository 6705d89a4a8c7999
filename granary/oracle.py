"""DuckDB SQL for the ledger's queries, written apart from the DataFrame code; word lists come from the same fixed values."""

from __future__ import annotations

from granary.functions import fixed
from granary.functions.classify import HOUSEHOLD, by_length
from granary.functions.fixed import lines, words
from granary.functions.text import any_of
from granary.sources.testbed import DESCRIPTIONS


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def has(column: str, needles: list[str]) -> str:
    return f"regexp_matches({column}, {q(any_of(needles))})"


def listed(text: str) -> str:
    return ", ".join(q(w) for w in words(text))


def case(pairs: list[tuple[str, str]], default: str = "null") -> str:
    return "case " + " ".join(f"when {a} then {b}" for a, b in pairs) + f" else {default} end"


_TITLE = r"array_to_string(list_transform(range(1, length({0}) + 1), lambda i: case when i = 1 or not regexp_matches(substr({0}, i - 1, 1), '[A-Za-z]') then upper(substr({0}, i, 1)) else lower(substr({0}, i, 1)) end), '')"


def _haystack(column: str) -> str:
    t = f"lower(trim(regexp_replace({column}, '\\s+', ' ', 'g')))"
    steps = [
        (r"https?://\S+", " "), (r"www\.[\w.]+\s*", " "), (rf"^(?:(?:{any_of(words(fixed.GATEWAY_PREFIXES))})\s*)+", ""), (r"\b\d{10,}\b", " "), (r"\b\d{3}-\d{3}-\d{4}\b", " "),
        (r"\s+#\s*\d+(\s+#\d+)*\s*$", ""), (r"\s+store\s+#?\d+\s*$", ""), (r"\s+loc(ation)?\s*\d+\s*$", ""), (r"\s+", " "),
    ]
    for pattern, by in steps:
        t = f"regexp_replace({t}, {q(pattern)}, {q(by)}, 'g')"
    return f"trim({t})"


def raw_cte() -> str:
    said = case([(f"(l_orderkey + l_linenumber) % {len(DESCRIPTIONS)} = {i}", "upper(p_name)" if d is None else q(d)) for i, d in enumerate(DESCRIPTIONS)])
    return f"""raw as (
  select l_orderkey * 10 + l_linenumber as tx_ref, 'st-' || lpad((c_custkey % 10000)::varchar, 4, '0') || '-' || strftime(o_orderdate, '%Y%m') as statement_id,
    case when c_mktsegment in ('AUTOMOBILE', 'BUILDING') then 'bank_account' when c_mktsegment = 'MACHINERY' then 'credit_line' else 'credit_card' end as statement_type,
    case when c_mktsegment in ('AUTOMOBILE', 'BUILDING') then 'chequing' when c_mktsegment = 'MACHINERY' then 'credit_line' when c_custkey % 2 = 0 then 'visa' else 'mastercard' end as account_kind,
    lpad((c_custkey % 10000)::varchar, 4, '0') as account_last4, 'acct-' || lpad((c_custkey % 10000)::varchar, 4, '0') as account_label, n_name as owner, o_orderdate::date as transaction_date,
    {said} as description, case when l_linenumber % 3 = 0 then l_orderkey::varchar else '' end as reference,
    (case when l_returnflag = 'R' then 1 else -1 end * l_extendedprice::decimal(18,2))::decimal(18,2) as amount
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join part on l_partkey = p_partkey)"""


def txn_cte(more: list[dict[str, str]] | None = None) -> str:
    """txn: the enriched, unpaired ledger; more: rules that come before the default ones."""
    rules = by_length((more or []) + fixed.category_rules())
    hit = lambda k: f"regexp_matches(rt, '(^|[^a-z0-9_]){k}([^a-z0-9_]|$)')" if len(k) <= 2 else f"contains(rt, {q(k)})"
    rule = lambda f, d="null": case([(f"rn = {i}", q(r[f])) for i, r in enumerate(rules)], d)
    aliases = sorted(fixed.merchant_aliases(), key=lambda p: -len(p[0]))
    necessity = lambda c: case([(f"{c} in ({', '.join(q(x) for x in cs)})", q(n)) for n, cs in lines(fixed.NECESSITY_OF)], "'Discretionary'")
    members = [(f"contains(lower(owner), {q(n)})", q(m)) for n, m in HOUSEHOLD.members]
    beneficiary = lambda c: case([(f"{c} = 'Kids & Family'", q(HOUSEHOLD.child)), (f"{c} in ({listed(fixed.SHARED_CATEGORIES)})", "'Shared'"), *members], "'Shared'")
    up = "trim(regexp_replace(regexp_replace(regexp_replace(upper(description), '\\b\\d{10,}\\b', '', 'g'), '\\b\\d{3}-\\d{3}-\\d{4}\\b', '', 'g'), '\\s+', ' ', 'g'))"
    up = f"regexp_replace({up}, '^[ -]+|[ -]+$', '', 'g')"
    return f"""{raw_cte()},
names as (select distinct description, lower(description) as t, {_haystack("description")} as hay, {up} as up from raw),
named as (select description, t, coalesce({case([(f"contains(hay, {q(n)})", q(lab)) for n, lab in aliases])}, case when up <> '' then {_TITLE.format("up")} end, 'Unknown Merchant') as merchant from names),
ruled as (select *, t || ' ' || lower(merchant) as rt from named),
numbered as (select description, t, merchant, rt, {case([(hit(r["keyword"]), str(i)) for i, r in enumerate(rules)])} as rn from ruled),
flowed as (select raw.*, merchant, rt, rn, t, case
    when {has("t", words(fixed.RECEIPT_MARKERS))} then 'Income' when {has("t", words(fixed.TRANSFER_WORDS))} then 'Internal Transfer' when {has("t", words(fixed.REFUND_WORDS))} then 'Refund'
    when {has("t", words(fixed.PAY_WORDS) + words(fixed.OTHER_INCOME_WORDS))} then 'Income' when {has("t", words(fixed.FEE_WORDS))} then 'Fees'
    when statement_type = 'credit_card' then case when amount > 0 then 'Expense' else 'Credit' end when amount < 0 then 'Expense' else 'Income' end as flow_type
  from raw join numbered using (description)),
classed as (select *, {rule("category", "'Other'")} as rc, case when statement_type = 'credit_card' then -amount else amount end as cash_flow_amount, flow_type = 'Internal Transfer' as is_internal,
    case when flow_type = 'Internal Transfer' then true when {has("t", words(fixed.RETAIL_DEBIT_MARKERS))} then false else {has("t", words(fixed.INTERNAL_PHRASES))} end as is_internal_candidate from flowed),
txn as (select * exclude (rt, t, rc, rn),
    case flow_type when 'Internal Transfer' then 'Internal Transfer' when 'Refund' then 'Refund' when 'Income' then case when {has("rt", words(fixed.PAY_WORDS))} then 'Salary & EI' else 'Income' end when 'Fees' then 'Fees' else rc end as category,
    case flow_type when 'Internal Transfer' then 'Savings & Transfers' when 'Refund' then 'Refund' when 'Income' then 'Income' when 'Fees' then 'Fixed Bills' else case when {rule("necessity", "'Auto'")} <> 'Auto' then {rule("necessity")} else {necessity("rc")} end end as necessity,
    case when flow_type in ('Internal Transfer', 'Income') then 'Shared' when flow_type in ('Refund', 'Fees') then {beneficiary("'Other'")} when {rule("beneficiary", "'Auto'")} <> 'Auto' then {rule("beneficiary")} else {beneficiary("rc")} end as beneficiary,
    case when flow_type = 'Internal Transfer' then 'internal transfer' when flow_type in ('Refund', 'Income', 'Fees') then '' else {rule("keyword", "''")} end as matched_keyword,
    case when is_internal or flow_type in ('Income', 'Refund', 'Credit') then 0::decimal(18,2) when flow_type = 'Fees' then abs(amount) when statement_type = 'credit_card' then greatest(amount, 0) else greatest(-amount, 0) end as expense_amount,
    strftime(transaction_date, '%Y-%m') as month, dayname(transaction_date) as weekday, case when is_internal_candidate then 'Unmatched' else 'None' end as internal_match_status,
    case when flow_type = 'Internal Transfer' then 'keyword' when is_internal_candidate then 'unmatched_candidate' else 'none' end as internal_detection,
    case when flow_type = 'Internal Transfer' then 'internal_keyword' when flow_type in ('Refund', 'Income', 'Fees') then 'auto' when {rule("keyword", "''")} <> '' then 'rule' else 'auto' end as category_source,
    statement_id || '|' || account_last4 || '|' || strftime(transaction_date, '%Y-%m-%d') || '|' || description || '|' || reference || '|' || regexp_replace(amount::varchar, '(\\.\\d)0$', '\\1') as tx_key
  from classed)"""


def over_txn(body: str, more: str = "", rules: list[dict[str, str]] | None = None) -> str:
    """body over scope (all rows), filtered (no internal rows) and expense (filtered, positive expense)."""
    return f"with {txn_cte(rules)}, scope as (select * from txn), filtered as (select * from txn where not is_internal), expense as (select * from filtered where expense_amount > 0){more} {body}"


def sums(keys: str, frame: str = "expense", value: str = "expense_amount", top: int | None = None) -> str:
    limit = f" order by sum({value}) desc, {keys} limit {top}" if top else ""
    return over_txn(f"select {keys}, sum({value})::double as value from {frame} group by {keys}{limit}")


def top_by_month(keys: str, top: int) -> str:
    return over_txn(f"select month, {keys}, value::double as value from (select month, {keys}, sum(expense_amount) as value, row_number() over (partition by month order by sum(expense_amount) desc, {keys}) as n from expense group by month, {keys}) where n <= {top}")


def spend_group(t: str) -> str:
    pairs = [(f"contains({t}, {q(fixed.SENT_TRANSFER)})", f"case when {has(t, words(fixed.LESSON_WORDS))} then 'Kids Education & Activities' else 'Personal E-Transfers' end")]
    return case(pairs + [(has(t, n), q(g)) for g, n in lines(fixed.SPEND_FIRST) + lines(fixed.SPEND_GROUPS)], "'Other / Review'")


def income_source(t: str) -> str:
    pairs = [(f"contains({t}, {q(n)})", q(e)) for n, e in HOUSEHOLD.employers] + [(has(t, n), q(s)) for s, n in lines(fixed.INCOME_SOURCES)]
    return case([*pairs, (has(t, words(fixed.INTERNAL_INFLOW_MARKERS)), "'Internal Transfer In'")], "'Other Inflow'")


#: Account-months whose number is no multiple of seven.
BY_NUMBER = "(replace(statement_month, '-', '')::int + account_last4::int) % 7 <> 0"


def stats_cte(full: str = BY_NUMBER, before: str = "") -> str:
    """rows: the ledger in twelve accounts by month; full_: those of account-months that are full; done: months in which every card is full.  before: more tables that the condition needs."""
    return f"""with {raw_cte()},{before}
rows as (select tx_ref // 10 as order_, account_kind || '-' || (account_last4::int % 4) as account_key, account_kind, (account_last4::int % 4)::varchar as account_last4, strftime(transaction_date, '%Y-%m') as statement_month, transaction_date, lower(description) as t, description, amount from raw),
full_ as (select * from rows where {full}),
am as (select account_key, account_kind, account_last4, statement_month, count(*) as transaction_count, sum(greatest(amount, 0)) as cash_in, sum(greatest(-amount, 0)) as cash_out, sum(amount) as net_cash_flow, sum(abs(amount)) as absolute_activity from full_ group by all),
cards as (select * from am where account_kind in ('visa', 'mastercard')),
cbm as (select statement_month, sum(cash_in) as credit_card_expense, sum(cash_out) as credit_card_payments_credits, sum(net_cash_flow) as net_credit_card_activity, sum(transaction_count)::bigint as credit_card_transactions, count(distinct account_key) as full_credit_card_count from cards group by 1),
done as (select statement_month from cbm where full_credit_card_count = (select count(distinct account_key) from cards)),
spend as (select *, abs(amount) as expense_amount, case when account_kind = 'chequing' then 'debit_bank' else 'credit_card' end as spend_source, {spend_group("t")} as smart_category
  from full_ where statement_month in (from done) and (account_kind in ('visa', 'mastercard') and amount > 0 or account_kind = 'chequing' and amount < 0 and not {has("t", words(fixed.OWN_TRANSFER_MARKERS))})),
inflow as (select *, {income_source("t")} as income_source, {has("t", words(fixed.INTERNAL_INFLOW_MARKERS))} as is_internal_inflow from full_ where account_kind = 'chequing' and amount > 0 and statement_month in (from done))
"""
