"""Reports saved by the executors: order, numbers, failed jobs."""

import threading

import pytest
from pyspark.sql import functions as F

from tarnwork.plans import render
from tarnwork.sources.report_file import save_rows, utc_day

DAY = "20260102"


def numbers(df, n=4):
    return df.repartitionByRange(n, "id").sortWithinPartitions("id").select(F.concat(F.lit("row "), F.col("id").cast("string")).alias("row"))


def test_rows_keep_the_order_of_partitions(spark, tmp_path):
    save_rows(numbers(spark.range(1000)), str(tmp_path), day=DAY, head="# H\n\n")
    assert [p.name for p in tmp_path.iterdir()] == [f"audit-result-{DAY}-001.md"]
    assert next(tmp_path.iterdir()).read_text() == "# H\n\n" + "".join(f"row {i}\n" for i in range(1000))


def test_jobs_at_the_same_time_get_numbers_of_their_own(spark, tmp_path):
    (tmp_path / f"audit-result-{DAY}-007.md").write_text("old")

    def job(n):
        save_rows(numbers(spark.range(n)), str(tmp_path), day=DAY)

    jobs = [threading.Thread(target=job, args=(50 + i,)) for i in range(4)]
    for j in jobs:
        j.start()
    for j in jobs:
        j.join()
    got = {p.name: p.read_text() for p in tmp_path.iterdir()}
    assert set(got) == {f"audit-result-{DAY}-{n:03d}.md" for n in (7, 8, 9, 10, 11)}
    assert sorted(t.count("\n") for n, t in got.items() if "007" not in n) == [50, 51, 52, 53]


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    bad = numbers(spark.range(1000)).select(F.when(F.col("row") == "row 900", F.raise_error("stop")).otherwise(F.col("row")).alias("row"))
    with pytest.raises(Exception, match="stop"):
        save_rows(bad, str(tmp_path), day=DAY)
    assert not list(tmp_path.iterdir())
    with pytest.raises(Exception, match="one string column"):
        save_rows(spark.range(3), str(tmp_path), day=DAY)
    assert not list(tmp_path.iterdir())


def test_ledger_of_no_findings_and_the_day_in_utc(spark, tmp_path):
    none = spark.createDataFrame([], "severity string, path string, line int, rule string, title string, evidence string")
    before = utc_day()
    render.save_ledger(none, str(tmp_path))
    name, text = [(p.name, p.read_text()) for p in tmp_path.iterdir()][0]
    assert name in {f"audit-result-{d}-001.md" for d in (before, utc_day())} and text == render.ledger(none)
    some = spark.createDataFrame([("high", f"a|{i}", i, "r", "t", "e\nf") for i in range(30)], none.schema).coalesce(1)
    render.save_ledger(some, str(tmp_path), day=DAY, stem="x")
    assert (tmp_path / f"x-{DAY}-001.md").read_text() == render.ledger(some)
    assert render.save_report("y", str(tmp_path), DAY, "x").name == f"x-{DAY}-002.md"
