"""Queries that no SQL or only part of one covers, and that every SQL gives rows."""

import pytest

from granary.functions.fixed import SECOND_PASS_LEAST
from granary.queries import ORACLE, QUERIES, transfer_legs

SF = "/root/testdata/sf0.001"


#: At this small scale no row is in question for these.
EMPTY = {"unmatched_internal"}


@pytest.mark.parametrize("name", sorted(set(ORACLE) - EMPTY))
def test_every_sql_gives_rows(duck, name):
    assert duck.execute(f"select count(*) from ({ORACLE[name]})").fetchone()[0] > 0


@pytest.mark.parametrize("name", ["account_month_coverage", "stats_credit_by_month", "stats_spend_totals", "stats_income_by_source", "audit_report", "audit_counts", "audit_statement_rows", "normalize_text", "clean_cell", "owner_beneficiary_matrix", "owner_category_matrix"])
def test_calendars_agree_with_sql(same, name):
    same(QUERIES[name], ORACLE[name])


def one_loop(rows, second, hinted):
    """Sequential greedy matching of legs in row order."""
    used, out = set(), {}
    for n in (r for r in rows if r["cash_flow_amount"] < 0):
        if second and -n["cash_flow_amount"] < SECOND_PASS_LEAST:
            continue
        best = None
        for p in (r for r in rows if r["cash_flow_amount"] > 0 and r["ingest_pos"] not in used):
            days = abs((p["transaction_date"] - n["transaction_date"]).days)
            if days > 7 or abs(float(p["cash_flow_amount"]) - float(-n["cash_flow_amount"])) > 0.01:
                continue
            same = n["account_label"] == p["account_label"]
            if second and (same or not (n["description"] in hinted or p["description"] in hinted)):
                continue
            refs = getattr(n, "reference", "") and n["reference"] == p["reference"]
            score = 100 - 10 * days + (35 if refs else 0) - (25 if same else 0) + (5 if n["owner"] == p["owner"] else 0)
            if best is None or score > best[0]:
                best = (score, p["ingest_pos"])
        if best:
            used.add(best[1])
            out[n["ingest_pos"]] = best[1]
    return out


@pytest.mark.parametrize(("name", "price", "hot"), [("transfer_pairs_all", "o_totalprice", 20_000), ("transfer_pairs_hot", "if(o_orderkey % 3 = 0, 100.0D, o_totalprice)", 20_000), ("transfer_pairs_hot", "if(o_orderkey % 3 = 0, 100.0D, o_totalprice)", 100)])
def test_all_legs_pair_as_in_one_loop(spark, monkeypatch, name, price, hot):
    """The last one cuts the popular amount into blocks."""
    monkeypatch.setattr("granary.operators.transfers.HOT_LEGS", hot)
    rows = sorted(transfer_legs(spark, SF, price).collect(), key=lambda r: r["ingest_pos"])
    first = one_loop([r for r in rows if r["is_internal_candidate"]], False, ())
    taken = set(first) | set(first.values())
    second = one_loop([r for r in rows if r["ingest_pos"] not in taken], True, {"online transfer", "visa thing"})
    want = sorted([*first.items(), *second.items()])
    got = {}
    for r in QUERIES[name](spark, SF).where("match_id <> ''").collect():
        got.setdefault(r["match_id"], []).append(r["ingest_pos"])
    legs = {r["ingest_pos"]: r["cash_flow_amount"] for r in rows}
    assert sorted(tuple(sorted(v, key=lambda x: legs[x])) for v in got.values()) == want


def test_the_report_of_pairs_has_them_all(spark):
    got = QUERIES["transfer_pairs_all"](spark, SF).where("match_id <> ''").select("match_id").distinct().count()
    assert QUERIES["matched_transfers_all"](spark, SF).count() == got > 100


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.startswith("stats_full_")))
def test_stats_follow_the_calendar(same, duck, name):
    same(QUERIES[name], ORACLE[name])
    assert duck.execute(f"select count(*) from ({ORACLE[name]})").fetchone()[0] > 0


def test_some_months_are_complete_and_some_are_not(duck):
    done, months = duck.execute(f"select count(*) filter (all_credit_cards_present), count(*) from ({ORACLE['stats_full_credit_expenses_by_month']})").fetchone()
    assert 0 < done < months


def test_the_rebuilt_ledger_pairs_as_one_loop(spark):
    """Duplicates, both passes and labels of the whole rebuild, against plain Python over its enriched rows."""
    from granary.functions.classify import has_timing_hint, plain
    from granary.operators.dedupe import row_fingerprint
    from granary.plans.rebuild import enrich
    from granary.queries import ordered_ledger
    from pyspark.sql import functions as F

    raw = ordered_ledger(spark, SF)
    rows = enrich(raw.withColumn("fp", row_fingerprint()), full_html=True).withColumn("hint", has_timing_hint(plain(F.col("description")))).collect()
    rows.sort(key=lambda r: r["ingest_pos"])
    first = rows
    for key in ("fp", "tx_key"):
        first = list({r[key]: r for r in reversed(first)}.values())[::-1]
    first.sort(key=lambda r: r["ingest_pos"])
    hinted = {r["description"] for r in first if r["hint"]}
    dated = [r for r in first if r["transaction_date"] and r["cash_flow_amount"]]
    one = one_loop([r for r in dated if r["is_internal_candidate"]], False, ())
    taken = set(one) | set(one.values())
    two = one_loop([r for r in dated if r["ingest_pos"] not in taken], True, hinted)
    pairs = sorted([*one.items(), *two.items()])
    got = QUERIES["rebuilt_facts"](spark, SF).collect()
    assert {r["ingest_pos"] for r in got} == {r["ingest_pos"] for r in first} and pairs
    legs = {}
    for r in got:
        if r["match_id"]:
            legs.setdefault(r["match_id"], []).append((r["cash_flow_amount"], r["ingest_pos"]))
            assert r["internal_detection"] == "paired" and r["is_internal"] and r["category"] == "Internal Transfer" and r["expense_amount"] == 0
    assert sorted(tuple(p for _, p in sorted(v)) for v in legs.values()) == pairs
    assert QUERIES["rebuilt_overview_scalars"](spark, SF).first()["matched_internal_pairs"] == len(pairs)
    assert QUERIES["rebuilt_matched_transfers"](spark, SF).count() > 0


def test_one_override_a_key_and_null_amounts(spark):
    from granary.operators import dedupe, overrides

    o = spark.createDataFrame([("k", "Groceries", "Auto", "Auto", 1), (" k ", "Transport", "Auto", "Auto", 2)], "tx_key string, category string, necessity string, beneficiary string, seq long")
    rows = spark.createDataFrame([("k", "Other", "x", "y", "auto", "")], "tx_key string, category string, necessity string, beneficiary string, category_source string, matched_keyword string")
    assert overrides.apply_overrides(rows, o).count() == overrides.apply_overrides(rows, o.drop("seq")).count() == 1
    seen = spark.createDataFrame([("a", 1, None, None, "x", ""), ("b", 2, None, None, "x", "")], "label string, pos long, transaction_date date, amount decimal(18,2), description string, reference string")
    got = dedupe.consensus(seen, 2).collect()
    assert len(got) == 1 and got[0]["amount"] is None and got[0]["extraction_confidence"] == 1.0


def test_reports_come_back(spark, tmp_path):
    from granary.plans import reports

    report = QUERIES["audit_report"](spark, SF)
    folder = f"file://{tmp_path}"
    reports.write_reports({"audit": report, "counts": reports.audit_counts(report)}, folder)
    got = reports.read_report(spark, folder, "counts", "files long, extracted long, failed long, reconciled long, not_reconciled long")
    assert got.collect() == reports.audit_counts(report).collect()
    rows = spark.createDataFrame([("a/b", 1), ("c", 2)], "statement_id string, n int")
    reports.write_statements(rows, f"{folder}/each")
    assert sorted(p.name for p in (tmp_path / "each").iterdir() if p.is_dir()) == ["statement=a_b", "statement=c"]
