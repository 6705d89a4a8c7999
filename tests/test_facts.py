"""The fact table: corrections, files of several schemas, what a run says of itself, versioned settings, edits of rules."""

import pytest
from pyspark.sql import functions as F

from granary.functions import fixed
from granary.operators import corrections as co
from granary.plans import facts
from granary.plans.rebuild import rebuild
from granary.queries import ORACLE, QUERIES, ordered_ledger
from granary.sources.settings import Settings, read_text, write_text

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["corrected_ledger", "facts_of_two_schemas", "extraction_quality", "edited_rules"])
def test_queries_agree_with_sql(same, name):
    same(QUERIES[name], ORACLE[name])


@pytest.fixture
def settings(spark, tmp_path):
    return Settings(spark, f"file://{tmp_path}/settings")


def items(spark, *rows):
    return spark.createDataFrame(list(rows), co.CORRECTION)


def test_corrections_give_what_a_whole_rebuild_gives(spark, tmp_path, settings):
    """Paired rows too: pairs stay, and a rule's keyword shows where the wording had one."""
    raw = ordered_ledger(spark, SF).where("account_label < 'acct-0040'")
    path = f"file://{tmp_path}/facts"
    facts.write_facts(rebuild(raw, full_html=False), path)
    key = facts.read_facts(spark, path).where("match_id = '' and category = 'Groceries'").agg(F.min("tx_key")).first()[0]
    asked = items(
        spark, (1, key, "Home", "Auto", "Auto", False, None), (2, f" {key} ", "Travel", "Essential", "Child", False, None), (3, "", "Gifts & Charity", None, None, True, "Netflix"), (4, None, "Home", None, None, True, "netflix"),
        (5, "no such key", "Home", "Auto", "Auto", True, "x"), (6, key, "no such category", "Auto", "Auto", False, None),
    )
    first = facts.apply_corrections(spark, path, settings, asked)
    want = rebuild(raw, settings.load_rules(), overrides=settings.load_overrides(), full_html=False)
    columns = ["tx_key", "category", "necessity", "beneficiary", "category_source", "matched_keyword", "match_id", "internal_detection", "flow_type", "expense_amount", "is_internal", "is_internal_candidate"]
    plain = lambda df: sorted(map(tuple, df.select(*columns).collect()))
    got = plain(facts.read_facts(spark, path))
    assert got == plain(want) and first
    # the first rule of a keyword counts; too short ones are none
    assert settings.load_rules()[0] == {"keyword": "netflix", "category": "Gifts & Charity", "necessity": "Auto", "beneficiary": "Auto"}
    assert len(settings.load_rules()) == len(fixed.category_rules()) + 1
    assert facts.apply_corrections(spark, path, settings, asked) == first
    assert plain(facts.read_facts(spark, path)) == got and len(settings.load_rules()) == len(fixed.category_rules()) + 1


def test_only_touched_months_are_rewritten(spark, tmp_path, settings):
    path = f"file://{tmp_path}/facts"
    facts.write_facts(rebuild(ordered_ledger(spark, SF).where("account_label < 'acct-0030'"), full_html=False), path)
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "facts").rglob("*.parquet")}
    before = files()
    row = facts.read_facts(spark, path).where("match_id = ''").orderBy("tx_key").first()
    assert facts.apply_corrections(spark, path, settings, items(spark, (1, row["tx_key"], "Travel", None, None, False, None))) == [row["month"]]
    after = files()
    changed = {p.parent.name for p in set(before) ^ set(after)}
    assert changed == {f"month={row['month']}"}
    assert facts.apply_corrections(spark, path, settings, items(spark, (1, "unknown", "Travel", None, None, False, None))) == []
    assert facts.apply_corrections(spark, path, settings, items(spark)) == []


def test_months_that_hold_the_corrections_are_not_written_again(spark, tmp_path, settings):
    path = f"file://{tmp_path}/facts"
    table = rebuild(ordered_ledger(spark, SF).where("account_label < 'acct-0030'"), full_html=False)
    facts.write_facts(table, path)
    files = lambda: sorted((str(p), p.stat().st_mtime_ns) for p in (tmp_path / "facts").rglob("*.parquet"))
    rows = [(r["tx_key"], r["month"]) for r in facts.read_facts(spark, path).where("match_id = ''").orderBy("tx_key").limit(40).collect()]
    one, two = rows[0], next(r for r in rows if r[1] != rows[0][1])
    ask = lambda *keys: facts.apply_corrections(spark, path, settings, items(spark, *[(i, k, "Travel", None, None, False, None) for i, k in enumerate(keys)]))
    travels = lambda: {r["tx_key"] for r in facts.read_facts(spark, path).where("category_source = 'override'").collect()}
    assert ask(one[0]) == [one[1]]
    held = files()
    assert ask(one[0]) == [one[1]] and files() == held and len(list((tmp_path / "settings").glob("overrides-*"))) == 1
    # other settings or files, or a broken note, and the month is written again
    assert ask(two[0], one[0]) == sorted([one[1], two[1]]) and travels() == {one[0], two[0]}
    facts.write_facts(table, path)
    assert not travels() and ask(one[0]) == [one[1]] and travels() == {one[0]}
    assert ask(two[0]) == [two[1]] and travels() == {one[0], two[0]}
    held = files()
    write_text(spark, f"{path}-corrected.json", "[ broken")
    assert ask(one[0]) == [one[1]] and files() != held and travels() == {one[0], two[0]}


def test_rows_without_dates_and_old_columns(spark, tmp_path):
    path = f"file://{tmp_path}/old"
    old = spark.createDataFrame([("s", "1", None, "a", "", 1.5, "own"), ("s", "1", None, "a", "", 1.5, "own"), ("s", "2", None, "b", None, 2.0, "own")], "statement_id string, account_last4 string, transaction_date date, description string, reference string, amount double, extra string")
    old.write.parquet(path)
    got = facts.read_facts(spark, path)
    assert got.count() == 2 and got.schema["amount"].dataType.simpleString() == "decimal(18,2)" and "extra" in got.columns
    row = got.where("description = 'a'").first()
    assert (row["tx_key"], row["internal_detection"], row["extraction_confidence"], row["extraction_disagreement"], row["month"]) == ("s|1||a||1.5", "none", 1.0, False, None)


def test_meta_of_good_broken_and_missing_files(spark, tmp_path):
    path = f"file://{tmp_path}/run/meta.json"
    facts.write_meta(spark, path, "2026-01-02T03:04:05Z", ["w"], ["a.pdf", "b.md"], {"mode": "always", "backends_configured": ["x"], "avg_confidence_global": 0.5, "total_low_confidence": 3, "other": 1})
    meta = facts.read_meta(spark, path)
    assert meta.first()["processed_files"] == ["a.pdf", "b.md"] and meta.first()["broken"] is None
    assert tuple(facts.extraction_quality(meta).first()) == ("always", ["x"], 0.5, 3, 0, 0, 0)
    empty = (None, [], None, 0, 0, 0, 0)
    write_text(spark, path, "{ broken")
    assert facts.read_meta(spark, path).first()["broken"] == "{ broken"
    for at in (path, f"file://{tmp_path}/none.json"):
        got = facts.read_meta(spark, at)
        assert got.first()["warnings"] == [] and tuple(facts.extraction_quality(got).first()) == empty


def test_settings_have_versions(spark, tmp_path, settings):
    assert settings.load_rules() == fixed.category_rules() and settings.load_aliases() == [] and settings.load_overrides().isEmpty()
    rules = [{"keyword": " A  B ", "category": "Nope", "necessity": "Essential", "beneficiary": "x"}, {"keyword": ""}, "no rule"]
    assert settings.save_rules(rules) == settings.load_rules() == [{"keyword": "a b", "category": "Other", "necessity": "Essential", "beneficiary": "Auto"}]
    edited = co.edit_rules(settings.rules(), co.RuleFilter(text="A B"), category="Home")
    settings.save_rules([r.asDict() for r in edited.orderBy("pos").collect()])
    assert settings.load_rules()[0]["category"] == "Home"
    assert settings.save_rules([]) == fixed.category_rules()
    assert [r.asDict()["keyword"] for r in settings.rules().orderBy("pos").limit(2).collect()] == [r["keyword"] for r in fixed.category_rules()[:2]]
    assert len(list((tmp_path / "settings").glob("rules-*.json"))) == 3
    write_text(spark, f"{settings.folder}/rules-000009.json", "[ broken")
    assert settings.load_rules() == fixed.category_rules()
    assert settings.save_aliases([("Foo  Bar ", "Foo"), ("", "x")]) == settings.load_aliases() == [("foo bar", "Foo")]
    write_text(spark, f"file://{tmp_path}/o.json", '{"k 1": {"category": "Home"}, "bad": 3}')
    settings.import_overrides(f"file://{tmp_path}/o.json")
    assert [tuple(r) for r in settings.load_overrides().collect()] == [("k 1", "Home", "Auto", "Auto")]
    settings.save_overrides(settings.load_overrides().where("false"))
    assert settings.load_overrides().isEmpty() and read_text(spark, f"file://{tmp_path}/o.json").startswith("{")


def test_rule_filters(spark):
    rules = spark.createDataFrame([("uber", "Travel", "Essential", "Shared"), ("costco", "Groceries", "Essential", "Child"), (None, "Home", "Auto", "Auto")], "keyword string, category string, necessity string, beneficiary string")
    shown = lambda **k: [r[1] for r in rules.where(co.RuleFilter(**k).matches()).collect()]
    assert shown() == ["Travel", "Groceries", "Home"] and shown(text="ESSENT") == ["Travel", "Groceries"] and shown(text="o", beneficiary="Auto") == ["Home"] and shown(text="%") == []
    with pytest.raises(ValueError):
        co.edit_rules(rules, co.RuleFilter(), keyword="x")
