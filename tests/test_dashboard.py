"""The dashboard as a whole: siblings from one pass, every dataset of it, and a stream of statements."""

from pyspark.sql import functions as F

from granary.operators.filters import Filters
from granary.plans import dashboard as d
from granary.queries import ORACLE, QUERIES, facts, txn

SF = "/root/testdata/sf0.001"


def test_siblings_agree_with_sql(same):
    same(QUERIES["dashboard_siblings"], ORACLE["dashboard_siblings"])


def test_siblings_equal_the_single_datasets_and_read_the_facts_once(spark):
    rows = txn(spark, SF).withColumn("owner", F.when(F.col("tx_ref") % 7 != 0, F.col("owner")))
    expense = d.frames(rows, Filters())[2]
    sets = d.siblings(expense)
    for n, k in d.SIMPLE.items():
        assert sets[n].collect() == d.ranked(expense, k).collect(), n
    for n, (k, top) in d.TOP.items():
        assert sets[n].collect() == d.ranked(expense, k, top).collect(), n
    for n, k in d.MONTHLY.items():
        assert sorted(sets[n].collect()) == sorted(d.by_month(expense, k).collect()), n
    for n, (k, top) in d.MONTHLY_TOP.items():
        assert sorted(sets[n].collect()) == sorted(d.by_month(expense, k, top).collect()), n


def test_every_dataset_of_the_dashboard_has_rows(spark):
    out = d.dashboard(facts(spark, SF), Filters(include_internal=True))
    assert len(out) >= 35
    empty = sorted(n for n, df in out.items() if df.isEmpty())
    assert empty in ([], ["unmatched_internal"])
    # orders of rows, as the dashboard shows them
    recent = [r["transaction_date"] for r in out["recent_transactions"].collect()]
    assert recent == sorted(recent, reverse=True)
    values = [r["value"] for r in out["category_breakdown"].collect()]
    assert values == sorted(values, reverse=True)


def test_statements_that_land_are_parsed_as_a_stream(spark, tmp_path):
    from granary.queries import statement_files
    from granary.sources.statements import parse_statements, statement_texts
    from granary.streaming.landing import parsed_stream

    files = statement_files(spark, SF).where("name like '%-0010 %' or name like '%-0013 %'").select("name", "text").collect()
    assert len(files) > 4
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()

    def run():
        parsed_stream(spark, f"file://{folder}").writeStream.format("parquet").option("path", f"file://{out}").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)

    half = len(files) // 2
    for part in (files[:half], files[half:]):
        for name, text in part:
            (folder / name).write_text(text)
        run()
    # the same once more gives nothing new
    run()
    plain = lambda df: sorted(map(str, df.select("source_file", "line_pos", "description", "amount", "transaction_date").collect()))
    got = plain(spark.read.parquet(f"file://{out}"))
    assert got == plain(parse_statements(spark.createDataFrame(files, "name string, text string"))) and len(got) > len(files)
    assert sorted(r["name"] for r in statement_texts(spark, f"file://{folder}").collect()) == sorted(n for n, _ in files)
