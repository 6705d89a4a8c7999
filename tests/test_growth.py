"""Steps whose cost has to grow no faster than the ledger."""

from pyspark.sql import functions as F

from granary.operators import dedupe
from granary.operators.dedupe import keep_first, without_repeats
from granary.sources import storage


def _rows(spark):
    rows = spark.range(4000).select(F.col("id").alias("ingest_pos"), F.concat(F.lit("k"), (F.col("id") * 7 % 3900).cast("string")).alias("key"), F.lit("x" * 50).alias("wide"))
    return storage.written(rows, "growth")


def test_repeats_go_as_with_a_window_over_whole_rows(spark, monkeypatch):
    rows = _rows(spark)
    want = sorted(r["ingest_pos"] for r in keep_first(rows, ["key"]).collect())
    assert len(want) == 3900
    for many in (10, dedupe.MANY):
        monkeypatch.setattr(dedupe, "MANY", many)
        assert sorted(r["ingest_pos"] for r in without_repeats(rows, F.col("key")).collect()) == want


def test_whole_rows_are_not_dealt_out_for_a_few_repeats(spark):
    plan = without_repeats(_rows(spark), F.col("key"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_tables_are_written_in_methods_that_are_compiled(spark, monkeypatch):
    name, seen = "spark.sql.codegen.hugeMethodLimit", []
    was, path = spark.conf.get(name), storage.shared_path
    monkeypatch.setattr(storage, "ship", lambda s: None)
    monkeypatch.setattr(storage, "shared_path", path)
    made = type(spark.range(1).write).parquet
    monkeypatch.setattr(type(spark.range(1).write), "parquet", lambda self, p, *a, **k: (seen.append(spark.conf.get(name)), made(self, p, *a, **k))[1])
    storage.written(spark.range(3), "huge")
    assert seen == ["8000"] and spark.conf.get(name) == was


def test_copies_are_dealt_out_before_they_are_sorted(spark):
    from granary.sources.statements import unique_statements

    files = storage.written(spark.createDataFrame([("1 Visa Statement-0001 2026-01-16", "pdf", True, "/drop/a"), ("1 Visa Statement-0001 2026-01-16-1", "md", False, "/up/b")], "stem string, ext string, drop boolean, path string"), "copies")
    got = unique_statements(files)
    assert [r["path"] for r in got.collect()] == ["/drop/a"]
    # a plan is printed from its end to the scan
    below = got._jdf.queryExecution().sparkPlan().toString()
    full = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "Window" in below and full.rindex("Exchange hashpartitioning(logical") > full.rindex("Sort [")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


def test_statistics_look_up_wording_once_for_each_description(spark):
    from granary import queries as q
    from conftest import SF

    for name in ("stats_full_all_spend_line_items", "stats_spend_totals", "stats_full_income_line_items"):
        plan = _plan(q.QUERIES[name](spark, SF))
        assert "Contains(" not in plan and "contains(" not in plan.lower(), name
        # the calendar and the account-months are on disk: rows meet them without being dealt out
        assert "SortMergeJoin" not in plan, name


def test_wording_of_no_description_and_of_one_with_no_group(spark):
    from granary.plans import stats

    rows = spark.createDataFrame([("a", "chequing", "2024-01", None, -5.0), ("a", "chequing", "2024-01", "zzz", -7.0), ("b", "visa", "2024-01", None, 3.0)], "account_key string, account_kind string, statement_month string, description string, amount double")
    months = spark.createDataFrame([("2024-01",)], "statement_month string")
    got = stats.spend_rows(rows, months, stats.wording(rows)).select("account_kind", "description", "expense_amount", "smart_category").collect()
    # rows without a description find their wording too
    assert sorted((r["account_kind"], r["expense_amount"]) for r in got) == [("chequing", 5.0), ("chequing", 7.0), ("visa", 3.0)]
    assert {r["smart_category"] for r in got} == {"Other / Review"}


def test_calendars_and_stated_totals_read_the_ledger_without_sorting_it(spark):
    from granary import queries as q
    from granary.operators import coverage
    from conftest import SF

    assert "SortAggregate(key=[account_key" not in _plan(q.stats_coverage(q.stats_rows(spark, SF))).split("Exchange hashpartitioning(account_key")[-1]
    known = storage.written(spark.range(50).select(F.concat(F.lit("a"), F.col("id") % 3).alias("account_key"), F.lit("visa").alias("account_kind"), F.lit("1").alias("account_last4"), F.lit("2024-01").alias("statement_month"), F.lit(1).alias("extract_row_count"), F.lit(True).alias("reconcile_ok"), F.lit("f").alias("filename"), F.lit("").alias("notes")), "known")
    least = _plan(coverage.account_months(known).select("account_key", "account_kind"))
    assert "HashAggregate(keys=[account_key#" in least and "account_kind#" in least.split("HashAggregate(keys=[account_key#")[1].split("]")[0]
    assert _plan(q.reconcile_totals(spark, SF)).count("lineitem.parquet") == 1


def test_the_audit_joins_each_file_once_and_makes_its_texts_once(spark, monkeypatch):
    from granary.plans import audit_job
    from granary.sources.statements import statement_meta

    made = []
    monkeypatch.setattr(audit_job, "written", lambda df, name: made.append(name) or storage.written(df, name))
    card = "STATEMENT FROM JAN 01, 2020 TO JAN 31, 2020\nPurchases & debits $2.00\nPayments & credits -$0.00\nJAN 02 JAN 02 SHOP\n$2.00\n" + " " * 60
    name = "Visa Statement-0001 2020-01-31.txt"
    calls = spark.sparkContext.accumulator(0)
    texts = F.udf(lambda x: (calls.add(1), x)[1])
    files = spark.createDataFrame([(name, card)], "name string, text string").withColumn("text", texts("text"))
    got = audit_job.run_audit(files, "statement_extraction")[0]
    assert calls.value == 1 and "audit-reconciliation" not in made
    row = got["statement_extraction"].collect()[0]
    assert (row["filename"], row["row_count"], row["extract_status"], row["account_key"]) == (name, 1, "ok", "visa-0001")
    # two files of one name are two rows, not four
    both = audit_job.run_audit(spark.createDataFrame([(name, card)] * 2, "name string, text string"), "statement_reconciliation")[0]
    assert both["statement_reconciliation"].count() == 2
    odd = spark.createDataFrame([("credit line statement-0007 2021-13-40 x",), ("Visa Statement-1 2020-01-31",), (None,)], "stem string")
    said = odd.select(*[c.alias(n) for n, c in statement_meta(F.col("stem")).items()]).collect()
    assert [tuple(r) for r in said] == [("credit_line", "0007", None, "2021-13", "credit_line-0007"), ("unknown", None, None, None, "unknown"), ("unknown", None, None, None, "unknown")]


def test_a_rebuild_writes_whole_rows_twice(spark, monkeypatch):
    from granary.plans import rebuild as plan
    from granary.queries import ordered_ledger
    from conftest import SF

    made, seen = storage.written, []
    monkeypatch.setattr(plan, "written", lambda df, name: (seen.append((name, "transaction_date" in df.columns)), made(df, name))[1])
    got = plan.rebuild(ordered_ledger(spark, SF).where("account_label < 'acct-0010'"), full_html=False)
    assert got.count() > 0 and [name for name, whole in seen if whole] == ["raw", "enriched"]
