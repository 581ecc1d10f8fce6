"""Queries of sources, sinks and the stream, over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar
from ..functions import calendar as cal_fn
from ..operators import baselines, clean, integrity, metrics, runs
from ..operators.panel import holiday_flag
from ..sources import guard, ledger, runlog
from ..streaming import rollup
from .feature_queries import _MONTHLY, _SPREAD, rounded
from .cleaning_queries import _RAW
from .forecast_queries import _BY, _COPIES, _DIAGNOSED, _OPS, _SHIFT
from .registry import BUSINESS, CAL, DAYS, FORECASTS, PANEL, business_panel, forecasts, order_panel, query, table, work_folder


@query("wide_ledger", "SELECT o_orderpriority AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS ds, sum(round(o_totalprice)) AS y FROM orders GROUP BY 1, 2")
def wide_ledger(spark, sf_dir):
    """A sheet for each year of the table, with months as columns, joined and turned long; cells that are blank stay out."""
    rows = order_panel(spark, sf_dir).withColumn("m", F.date_format("ds", "yyyy-MM-01"))
    span = rows.agg(F.min(F.year("ds")).alias("a"), F.max(F.year("ds")).alias("b")).first()
    sheets = [rows.groupBy("series_id").pivot("m", [f"{y}-{m:02d}-01" for m in range(1, 13)]).agg(F.sum("y")) for y in range(span["a"], span["b"] + 1)]
    return ledger.wide_to_long(ledger.union_years(*sheets), "series_id").where("y IS NOT NULL")


@query("coerce_text", "SELECT CAST(o_orderdate AS DATE) AS ds, count(*) AS n, count(CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 1 END) AS n_value FROM orders WHERE o_orderkey % 11 <> 0 GROUP BY 1")
def coerce_text(spark, sf_dir):
    day = F.when(F.col("o_orderkey") % 11 == 0, "not a date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    value = F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string"))
    rows = ledger.coerce(table(spark, sf_dir, "orders").select(day.alias("day"), value.alias("value")), "day", ["value"])
    return rows.groupBy("ds").agg(F.count("*").alias("n"), F.count("value").alias("n_value"))


@query("guess_date_column", """SELECT 'o_orderdate' AS "column", CAST(1 AS DOUBLE) AS parsed, round(avg(CASE WHEN up THEN 1.0 ELSE 0.0 END), 6) AS rising FROM (SELECT o_orderdate >= lag(o_orderdate) OVER (ORDER BY o_orderkey) AS up FROM orders) WHERE up IS NOT NULL UNION ALL SELECT c, CAST(0 AS DOUBLE), NULL FROM (VALUES ('o_custkey'), ('o_orderstatus'), ('o_orderpriority'), ('o_totalprice')) t(c)""")
def guess_date_column(spark, sf_dir):
    out = ledger.date_shares(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate"), "o_orderkey")
    return rounded(out, 6, "rising").select("column", "parsed", "rising")


@query("guess_value_column", """SELECT * FROM (SELECT 'o_totalprice' AS "column", CAST(1 AS DOUBLE) AS numeric, round(quantile_cont(abs(o_totalprice), 0.9), 3) AS p90, 1 AS rank FROM orders
  UNION ALL SELECT 'o_orderkey', CAST(1 AS DOUBLE), round(quantile_cont(abs(o_orderkey), 0.9), 3), 2 FROM orders UNION ALL SELECT 'o_orderstatus', CAST(0 AS DOUBLE), NULL, 3)""")  # fmt: skip
def guess_value_column(spark, sf_dir):
    out = ledger.value_shares(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"))
    return rounded(out, 3, "p90").withColumn("rank", F.col("rank").cast("int"))


_PICKED = [("orders", "o_orderdate", "o_totalprice"), ("lineitem", "l_shipdate", "l_extendedprice"), ("events", "ts", "value")]


@query("pick_by_name", " UNION ALL ".join(f"""SELECT '{t}' AS "table", '{d}' AS date_column, '{v}' AS value_column, CAST(min({d}) AS DATE) AS first_day, CAST(max({d}) AS DATE) AS last_day FROM {t}""" for t, d, v in _PICKED))
def pick_by_name(spark, sf_dir):
    """Tables' date and value columns by name, and the days they span."""
    out = None
    for name in ("orders", "lineitem", "events"):
        rows = table(spark, sf_dir, name)
        date, value = ledger.pick_by_name(rows.columns, ledger.DATE_NAMES), ledger.pick_by_name(rows.columns, ledger.VALUE_NAMES)
        own = rows.agg(F.lit(name).alias("table"), F.lit(date).alias("date_column"), F.lit(value).alias("value_column"), F.min(F.to_date(date)).alias("first_day"), F.max(F.to_date(date)).alias("last_day"))
        out = own if out is None else out.unionByName(own)
    return out


@query("tail_sample", "SELECT series_id, ds, y FROM panel ORDER BY ds DESC, series_id, y LIMIT 50", PANEL)
def tail_sample(spark, sf_dir):
    return ledger.tail_sample(order_panel(spark, sf_dir), 50)


@query("csv_round_trip", "SELECT series_id, ds, y FROM panel", PANEL)
def csv_round_trip(spark, sf_dir):
    """A panel through CSV and back by the reader for text."""
    path = work_folder(spark) + "/panel.csv"
    order_panel(spark, sf_dir).write.csv(path, header=True)
    rows = ledger.read_any(spark, path)
    return rows.select("series_id", F.to_date("ds").alias("ds"), F.expr("try_cast(y AS double)").alias("y"))


@query("saved_runs", "SELECT model, 'daily' AS cadence, 'r1' AS run, count(*) AS n FROM preds GROUP BY 1", *FORECASTS)
def saved_runs(spark, sf_dir):
    path = work_folder(spark) + "/daily/run_id=r1"
    runlog.write_table(forecasts(spark, sf_dir), path, "model")
    return ledger.load_runs(spark, path).groupBy("model", "cadence", "run").agg(F.count("*").alias("n"))


@query("discover_runs", "SELECT 'one' AS run, 'daily' AS cadence, model, count(*) AS n FROM preds GROUP BY model UNION ALL SELECT 'two', '', model, count(*) FROM preds WHERE model = 'naive_last' GROUP BY model", *FORECASTS)
def discover_runs(spark, sf_dir):
    """Two runs, one with its outputs by cadence, one with them at the top, found and read back."""
    root, rows = work_folder(spark), forecasts(spark, sf_dir)
    rows.write.parquet(f"{root}/one/outputs/daily/predictions")
    rows.where("model = 'naive_last'").write.parquet(f"{root}/two/outputs/predictions")
    return ledger.load_outputs(spark, root).groupBy("run", "cadence", "model").agg(F.count("*").alias("n"))


@query("holiday_list", "SELECT b.series_id, b.ds, CAST(h.ds IS NOT NULL AS INTEGER) AS is_holiday FROM biz b LEFT JOIN hols h ON h.ds = b.ds", *BUSINESS, CAL)
def holiday_list(spark, sf_dir):
    """A list of holidays with repeats and a row that is no date, written as text, read and joined to the panel."""
    path, days = work_folder(spark) + "/holidays.csv", calendar.holidays(spark, 1995, 2001)
    rows = days.select(F.col("ds").cast("string").alias("Date")).unionByName(days.where("day(ds) = 1").select(F.col("ds").cast("string").alias("Date"))).unionByName(spark.range(1).select(F.lit("not known").alias("Date")))
    rows.write.csv(path, header=True)
    return holiday_flag(business_panel(spark, sf_dir), ledger.read_holidays(spark, path)).select("series_id", "ds", "is_holiday")


@query("ops_weekly", "SELECT series_id, CAST(ds + CAST((5 - isodow(ds) + 7) % 7 AS INTEGER) AS DATE) AS ds, round(sum(round(baseline)), 2) AS baseline FROM ops WHERE baseline IS NOT NULL GROUP BY 1, 2", *FORECASTS, _MONTHLY, _SPREAD, _OPS)
def ops_weekly(spark, sf_dir):
    """The daily operational baseline as files of text by series, read back as weeks."""
    path, panel = work_folder(spark) + "/ops.csv", business_panel(spark, sf_dir)
    daily = baselines.spread_month(panel, baselines.monthly_baseline(panel)).where("baseline IS NOT NULL")
    daily.select("series_id", F.col("ds").alias("date"), F.round("baseline").alias("forecast")).write.partitionBy("series_id").csv(path, header=True)
    return rounded(ledger.read_ops(spark, path, cadence="weekly"), 2, "baseline")


@query("experiment_log", "SELECT target, count(*) AS n, count(DISTINCT model) AS n_models FROM (SELECT series_id AS target, model FROM preds GROUP BY 1, 2 UNION ALL SELECT DISTINCT series_id, 'persistence' FROM preds) GROUP BY 1", *FORECASTS)
def experiment_log(spark, sf_dir):
    path = work_folder(spark) + "/log"
    runlog.append_log(runlog.log_rows(metrics.leaderboard(forecasts(spark, sf_dir)), {"window": "20"}), path)
    if runlog.check_log(spark, path).head(1):
        raise ValueError("an id repeats in the log")
    return spark.read.parquet(path).groupBy("target").agg(F.count("*").alias("n"), F.countDistinct("model").alias("n_models"))


@query("integrity_report", f"""SELECT d.series_id, d.model, d.horizon, d.best_shift, d.shift_class, d.naive_equivalent, c.best_shift AS copy_shift, c.is_copy, l.n_leaks, a.n AS n_aligned, a.faulty AS n_faulty FROM diagnosed d LEFT JOIN copies c ON c.series_id = d.series_id AND c.model = d.model AND c.horizon = d.horizon
  JOIN (SELECT {_BY}, count(*) FILTER (origin_date >= target_date) AS n_leaks FROM preds GROUP BY 1, 2, 3) l ON l.series_id = d.series_id AND l.model = d.model AND l.horizon = d.horizon
  JOIN (SELECT p.series_id, count(*) AS n, count(*) FILTER (t.pos IS DISTINCT FROM o.pos + p.horizon) AS faulty FROM preds p LEFT JOIN biz o ON o.series_id = p.series_id AND o.ds = p.origin_date LEFT JOIN biz t ON t.series_id = p.series_id AND t.ds = p.target_date GROUP BY 1) a ON a.series_id = d.series_id""", *FORECASTS, _SHIFT, _DIAGNOSED, _COPIES)  # fmt: skip
def integrity_report(spark, sf_dir):
    """All checks of all models as a nested JSON document for each series, written, read back and laid flat."""
    path = work_folder(spark) + "/report"
    runlog.write_report(runs.check_documents(forecasts(spark, sf_dir), business_panel(spark, sf_dir), integrity.reach(5)), path)
    rows = runlog.read_report(spark, path).select("series_id", "aligned", F.explode("models").alias("m"))
    return rows.select("series_id", "m.model", "m.horizon", F.col("m.shift.best").alias("best_shift"), F.col("m.shift.class").alias("shift_class"), "m.shift.naive_equivalent", F.col("m.copy.best").alias("copy_shift"), "m.copy.is_copy", "m.n_leaks", F.col("aligned.n").alias("n_aligned"), F.col("aligned.faulty").alias("n_faulty"))


@query("variant_files", """SELECT v.variant, v.series_id, count(*) AS n, sum(v.y) AS total, count(*) FILTER (place <= 40) AS n_shown, min(v.ds) FILTER (place <= 40) AS first_shown FROM (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY series_id, ds) AS place FROM (
  SELECT 'raw' AS variant, series_id, ds, y FROM rawp UNION ALL SELECT 'conservative', series_id, ds, coalesce(y, 0.0) FROM daysp
  UNION ALL SELECT 'treasury', r.series_id, r.ds, CASE WHEN i.ds IS NULL THEN r.y ELSE i.med END FROM rawp r LEFT JOIN imp i ON i.series_id = r.series_id AND i.ds = r.ds)) v GROUP BY 1, 2""", PANEL, DAYS, CAL, _RAW)  # fmt: skip
def variant_files(spark, sf_dir):
    """The three cleaned variants as files, and their previews: what is read back."""
    path = work_folder(spark) + "/cleaned"
    runlog.write_variants(clean.variants(order_panel(spark, sf_dir), cal_fn.calendar(spark, 1995, 2001)), path, 40)
    shown = runlog.read_preview(spark, path).groupBy("variant", "series_id").agg(F.count("*").alias("n_shown"), F.min("ds").alias("first_shown"))
    data = runlog.read_variants(spark, path).groupBy("variant", "series_id").agg(F.count("*").alias("n"), F.sum("y").alias("total"))
    return data.join(shown, ["variant", "series_id"], "left").withColumn("n_shown", F.coalesce("n_shown", F.lit(0))).select("variant", "series_id", "n", "total", "n_shown", "first_shown")


#: Held back from everything but a final score.
LOCKED = [("2001-01-01", "2001-12-31")]


@query("unlocked_orders", "SELECT o_orderpriority AS series_id, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n, sum(round(o_totalprice)) AS total FROM orders WHERE o_orderdate < DATE '2001-01-01' OR o_orderdate >= DATE '2002-01-01' GROUP BY 1, 2")
def unlocked_orders(spark, sf_dir):
    """What is read without a reason: no order of the locked year."""
    rows = guard.read(spark, f"{sf_dir}/orders.parquet", "o_orderdate", LOCKED)
    return rows.groupBy(F.col("o_orderpriority").alias("series_id"), F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"), F.sum(F.round("o_totalprice")).alias("total"))


@query("logged_holdout_read", "SELECT '2001-01-01' AS first, '2001-12-31' AS last, 'final score' AS reason, count(*) AS n, sum(round(o_totalprice)) AS total FROM orders WHERE o_orderdate >= DATE '2001-01-01' AND o_orderdate < DATE '2002-01-01'")
def logged_holdout_read(spark, sf_dir):
    """A window that is refused without a reason, read with one: the log's entry beside what was read."""
    log, path = work_folder(spark) + "/reads", f"{sf_dir}/orders.parquet"
    try:
        guard.read(spark, path, "o_orderdate", LOCKED, LOCKED[0])
        raise AssertionError("a locked window was read without a reason")
    except guard.LockedWindow:
        rows = guard.read(spark, path, "o_orderdate", LOCKED, LOCKED[0], "final score", log)
    found = rows.agg(F.lit("final score").alias("reason"), F.count("*").alias("n"), F.sum(F.round("o_totalprice")).alias("total"))
    entry = guard.reads(spark, log).select(F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last"), "reason")
    return entry.join(found, "reason").select("first", "last", "reason", "n", "total")


@query("provenance")
def provenance(spark, sf_dir):
    return runlog.provenance(order_panel(spark, sf_dir), "ds")


@query("stream_rollup", "SELECT event_type AS series_id, CAST(ts AS DATE) AS ds, count(*) AS n, sum(round(value)) AS y FROM events WHERE CAST(ts AS DATE) < (SELECT CAST(max(ts) - INTERVAL 2 DAY AS DATE) FROM events) GROUP BY 1, 2")
def stream_rollup(spark, sf_dir):
    top = work_folder(spark)
    table(spark, sf_dir, "events").write.parquet(f"{top}/in")
    return rollup.run_rollup(spark, f"{top}/in", f"{top}/out", f"{top}/checkpoint")


@query("batch_rollup", "SELECT event_type AS series_id, CAST(ts AS DATE) AS ds, count(*) AS n, sum(round(value)) AS y FROM events GROUP BY 1, 2")
def batch_rollup(spark, sf_dir):
    return rollup.daily_rollup(table(spark, sf_dir, "events"))
