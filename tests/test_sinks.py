"""Locked windows, the nested report of checks, files of cleaned variants."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import calendar
from ledgerloom.operators import baselines, clean, integrity, runs
from ledgerloom.sources import guard, runlog

LOCKED = [("2020-03-01", "2020-03-31"), ("2020-06-01", "2020-06-30")]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("locked") / "t.parquet")
    days = spark.sql("SELECT explode(sequence(DATE '2020-01-01', DATE '2020-07-31')) AS ds")
    days.unionByName(spark.sql("SELECT CAST(NULL AS DATE) AS ds")).withColumn("y", F.lit(1.0)).write.parquet(path)
    return path


def test_locked_days_are_left_out_or_refused(spark, table, tmp_path):
    log = str(tmp_path / "log")
    free = guard.read(spark, table, "ds", LOCKED)
    assert free.where("ds BETWEEN '2020-03-01' AND '2020-03-31' OR month(ds) = 6").count() == 0
    assert free.count() == 213 - 31 - 30 + 1  # rows without a date stay
    assert guard.read(spark, table, "ds", LOCKED, ("2020-04-01", "2020-05-31")).count() == 61
    for window in (("2020-02-20", "2020-03-01"), ("2020-06-30", "2020-07-10"), ("2020-01-01", "2020-12-31")):
        for reason in (None, "", "  "):
            with pytest.raises(guard.LockedWindow):
                guard.read(spark, table, "ds", LOCKED, window, reason, log)
    with pytest.raises(ValueError, match="log"):
        guard.read(spark, table, "ds", LOCKED, LOCKED[0], "because")


def test_reads_are_logged(spark, table, tmp_path):
    log = str(tmp_path / "log")
    assert guard.read(spark, table, "ds", LOCKED, ("2020-03-10", "2020-03-20"), " final ", log).count() == 11
    assert guard.read(spark, table, "ds", LOCKED, None, "audit", log).count() == 214
    guard.read(spark, table, "ds", LOCKED, ("2020-05-01", "2020-05-02"), "not needed", log)
    got = sorted((r["reason"], r["first"], r["last"], r["path"] == table, r["at"] is not None) for r in guard.reads(spark, log).collect())
    assert got == [("audit", date(2020, 3, 1), date(2020, 3, 31), True, True), ("audit", date(2020, 6, 1), date(2020, 6, 30), True, True), ("final", date(2020, 3, 1), date(2020, 3, 31), True, True)]


def test_the_scan_has_the_windows(spark, table):
    """Row groups of a locked window are skipped: the conditions are pushed to the scan."""
    plan = guard.read(spark, table, "ds", LOCKED)._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("\n")[0]
    assert pushed.count("LessThan(ds,") >= 1 and pushed.count("GreaterThanOrEqual(ds,") >= 1
    plan = guard.read(spark, table, "ds", LOCKED, ("2020-04-01", "2020-04-30"))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ds,2020-04-01)" in plan and "LessThan(ds,2020-05-01)" in plan


def test_report_documents_read_back(spark, tmp_path):
    days = [d for d in spark.sql("SELECT explode(sequence(DATE '2020-01-06', DATE '2020-10-30')) AS ds").where("weekday(ds) < 5").collect()]
    panel = spark.createDataFrame([(s, r["ds"], i, float((i * 37) % 101 + k)) for k, s in enumerate("ab") for i, r in enumerate(days)], "series_id string, ds date, pos int, y double")
    preds = baselines.window_forecasts(panel, 5)
    bad = preds.where("series_id = 'b'").withColumn("target_date", F.when(F.col("origin_date") == F.lit(days[50]["ds"]), F.date_add("target_date", 400)).otherwise(F.col("target_date")))
    signal = spark.createDataFrame([("a", True)], "series_id string, has_signal boolean")
    docs = runs.check_documents(preds.where("series_id = 'a'").unionByName(bad), panel, integrity.reach(5), signal)
    path = str(tmp_path / "report")
    runlog.write_report(docs, path)
    back = runlog.read_report(spark, path)
    assert sorted(map(str, back.collect())) == sorted(map(str, docs.collect()))
    a, b = (back.where(F.col("series_id") == s).first() for s in "ab")
    assert (a["has_signal"], b["has_signal"]) == (True, None) and a["aligned"]["faulty"] == 0 and b["aligned"]["faulty"] == 3 and len(b["aligned"]["examples"]) == 1
    assert [m["model"] for m in a["models"]] == ["moving_average_20", "naive_last", "weekday_mean"] and all(m["n_leaks"] == 0 and m["shift"]["class"] for m in a["models"])
    assert [m["copy"] is None for m in a["models"]] == [False, True, False]  # persistence copies by design


def test_variant_files_read_back(spark, tmp_path):
    days = spark.sql("SELECT explode(sequence(DATE '2020-01-01', DATE '2020-02-29')) AS ds")
    panel = days.where("day(ds) % 7 <> 3").select(F.explode(F.array(F.lit("b"), F.lit("a"))).alias("series_id"), "ds", F.dayofmonth("ds").cast("double").alias("y"))
    made = clean.variants(panel, calendar.calendar(spark, 2020, 2020))
    path = str(tmp_path / "v")
    runlog.write_variants(made, path, 10)
    back = runlog.read_variants(spark, path)
    assert back.select(made.columns).exceptAll(made).count() == 0 and made.exceptAll(back.select(made.columns)).count() == 0
    shown = runlog.read_preview(spark, path).orderBy("variant", "place").collect()
    want = sorted(made.collect(), key=lambda r: (r["variant"], r["series_id"], r["ds"]))
    for v in ("raw", "conservative", "treasury"):
        first = [r for r in want if r["variant"] == v][:10]
        assert [(r["series_id"], r["ds"], r["y"]) for r in shown if r["variant"] == v] == [(r["series_id"], r["ds"], r["y"]) for r in first]
    runlog.write_variants(made.repartition(7, "y"), path, 10)  # the same preview, whatever order rows come in
    assert runlog.read_preview(spark, path).orderBy("variant", "place").collect() == shown
