"""Queries of panel shaping and causal cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal_fn
from ..operators import clean, panel as pn
from .registry import BUSINESS, CAL, DAYS, PANEL, WINDOWS, business_panel, order_panel, query, table


@query("classify_kind", "SELECT o_orderpriority AS series_id, o_orderstatus AS status, CASE WHEN regexp_matches(lower(o_orderpriority || ' ' || CASE WHEN o_orderstatus = 'O' THEN 'balance' ELSE 'flow' END), 'balance|stock|level|cash_on_hand') THEN 'level' ELSE 'flow' END AS kind, count(*) AS n FROM orders GROUP BY 1, 2, 3")
def classify_kind(spark, sf_dir):
    name = F.concat_ws(" ", "o_orderpriority", F.when(F.col("o_orderstatus") == "O", "balance").otherwise("flow"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("series_id"), F.col("o_orderstatus").alias("status"), pn.classify_kind(name).alias("kind")).groupBy("series_id", "status", "kind").agg(F.count("*").alias("n"))


@query("sum_duplicates", "SELECT l_returnflag || l_linestatus AS series_id, CAST(l_shipdate AS DATE) AS ds, SUM(CASE WHEN l_discount > 0.05 THEN NULL ELSE round(l_extendedprice) END) AS y FROM lineitem GROUP BY 1, 2")
def sum_duplicates(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("series_id"), F.to_date("l_shipdate").alias("ds"), F.when(F.col("l_discount") > 0.05, None).otherwise(F.round("l_extendedprice")).alias("y"))
    return pn.sum_duplicates(rows)


@query("daily_reindex", "SELECT * FROM daysp", PANEL, DAYS)
def daily_reindex(spark, sf_dir):
    return pn.daily_reindex(order_panel(spark, sf_dir)).select("series_id", "ds", "y", "is_reported")


@query("business_index", "SELECT * FROM biz", *BUSINESS)
def business_index(spark, sf_dir):
    return business_panel(spark, sf_dir)


@query("business_index_level", "SELECT series_id, ds, CAST(row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS INTEGER) AS pos, last_value(y IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y FROM daysp WHERE isodow(ds) < 6", PANEL, DAYS)
def business_index_level(spark, sf_dir):
    return pn.business_index(order_panel(spark, sf_dir), "level").select("series_id", "ds", "pos", "y")


@query("first_of_day", """SELECT series_id, ds, o_orderkey, y FROM (SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS ds, o_orderkey, round(o_totalprice) AS y,
  row_number() OVER (PARTITION BY o_orderpriority, CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1""")  # fmt: skip
def first_of_day(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("ds"), "o_orderkey", F.round("o_totalprice").alias("y"))
    return pn.one_per_date(rows, "o_orderkey")


@query("last_of_day", """SELECT series_id, ds, o_orderkey, y FROM (SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS ds, o_orderkey, round(o_totalprice) AS y,
  row_number() OVER (PARTITION BY o_orderpriority, CAST(o_orderdate AS DATE) ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n = 1""")  # fmt: skip
def last_of_day(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("ds"), "o_orderkey", F.round("o_totalprice").alias("y"))
    return pn.one_per_date(rows, "o_orderkey", "last")


@query("finite_values", "SELECT event_type AS series_id, count(*) AS n, count(v) AS n_finite, round(sum(v), 4) AS total FROM (SELECT event_type, CASE WHEN value > 50 THEN NULL ELSE value END AS v FROM events) GROUP BY 1")
def finite_values(spark, sf_dir):
    v = F.when(F.col("value") > 90, float("inf")).when(F.col("value") > 50, float("nan")).otherwise(F.col("value"))
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"), pn.finite(v).alias("v"))
    return rows.groupBy("series_id").agg(F.count("*").alias("n"), F.count("v").alias("n_finite"), F.round(F.sum("v"), 4).alias("total"))


@query("window_membership", """SELECT series_id, w AS window_name, count(*) AS n, sum(y) AS y FROM (SELECT series_id, y, CASE WHEN ds BETWEEN DATE '1995-01-01' AND DATE '1999-12-31' THEN 'TRAIN'
  WHEN ds BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' THEN 'DEV' WHEN ds BETWEEN DATE '2001-01-01' AND DATE '2001-12-31' THEN 'TEST' END AS w FROM panel) GROUP BY 1, 2""", PANEL)  # fmt: skip
def window_membership(spark, sf_dir):
    rows = order_panel(spark, sf_dir).withColumn("window_name", pn.in_window("ds", WINDOWS))
    return rows.groupBy("series_id", "window_name").agg(F.count("*").alias("n"), F.sum("y").alias("y"))


@query("last_months", "SELECT p.series_id, ds, y FROM panel p JOIN (SELECT series_id, max(ds) AS e FROM panel GROUP BY 1) m ON m.series_id = p.series_id WHERE ds >= e - INTERVAL 6 MONTH", PANEL)
def last_months(spark, sf_dir):
    return pn.last_months(order_panel(spark, sf_dir), 6)


@query("suspicious_zeros", """SELECT b.series_id, pos, CASE WHEN r <= 10 AND y = 0 AND usual > 0 THEN NULL ELSE y END AS y FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY pos DESC) AS r FROM biz) b
  JOIN (SELECT series_id, median(y) AS usual FROM biz GROUP BY 1) u ON u.series_id = b.series_id""", *BUSINESS)  # fmt: skip
def suspicious_zeros(spark, sf_dir):
    return pn.suspicious_zeros(business_panel(spark, sf_dir)).select("series_id", "pos", "y")


@query("running_balance", """SELECT f.series_id, f.ds, sum(f.y - coalesce(s.y, 0.0)) OVER (PARTITION BY f.series_id ORDER BY f.ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y
  FROM (SELECT 'all' AS series_id, coalesce(a.ds, b.ds) AS ds, coalesce(a.y, 0.0) AS y FROM (SELECT ds, sum(y) AS y FROM panel GROUP BY 1) a FULL JOIN shipped b ON b.ds = a.ds) f LEFT JOIN shipped s ON s.ds = f.ds""", PANEL, "shipped AS (SELECT CAST(l_shipdate AS DATE) AS ds, sum(round(l_extendedprice)) AS y FROM lineitem GROUP BY 1)")  # fmt: skip
def running_balance(spark, sf_dir):
    value = order_panel(spark, sf_dir).groupBy("ds").agg(F.sum("y").alias("f"))
    out = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("ds")).agg(F.sum(F.round("l_extendedprice")).alias("s"))
    return pn.running_balance(value.join(out, "ds", "full").select(F.lit("all").alias("series_id"), "ds", (F.coalesce("f", F.lit(0.0)) - F.coalesce("s", F.lit(0.0))).alias("y")))


@query("first_difference", "SELECT series_id, ds, y, y - lag(y) OVER (PARTITION BY series_id ORDER BY ds) AS diff FROM panel", PANEL)
def first_difference(spark, sf_dir):
    return pn.first_difference(order_panel(spark, sf_dir)).select("series_id", "ds", "y", "diff")


_WEEKS = "wk AS (SELECT series_id, CAST(ds + CAST((5 - isodow(ds) + 7) % 7 AS INTEGER) AS DATE) AS bucket, sum(y) AS y FROM panel GROUP BY 1, 2)"


@query("resample_weekly", """SELECT s.series_id, s.bucket, coalesce(w.y, 0.0) AS y FROM (SELECT series_id, CAST(unnest(generate_series(min(bucket), max(bucket), INTERVAL 7 DAY)) AS DATE) AS bucket FROM wk GROUP BY 1) s
  LEFT JOIN wk w ON w.series_id = s.series_id AND w.bucket = s.bucket""", PANEL, _WEEKS)  # fmt: skip
def resample_weekly(spark, sf_dir):
    return pn.resample(order_panel(spark, sf_dir), "weekly")


@query("resample_monthly_level", """SELECT s.series_id, last_day(s.m) AS bucket, w.y FROM (SELECT series_id, CAST(unnest(generate_series(date_trunc('month', min(ds)), date_trunc('month', max(ds)), INTERVAL 1 MONTH)) AS DATE) AS m FROM panel GROUP BY 1) s
  LEFT JOIN (SELECT series_id, CAST(date_trunc('month', ds) AS DATE) AS m, max_by(y, ds) AS y FROM panel GROUP BY 1, 2) w ON w.series_id = s.series_id AND w.m = s.m""", PANEL)  # fmt: skip
def resample_monthly_level(spark, sf_dir):
    return pn.resample(order_panel(spark, sf_dir), "monthly", "level")


@query("events_weekly", """SELECT s.series_id, s.bucket, coalesce(w.y, 0.0) AS y FROM (SELECT series_id, CAST(unnest(generate_series(min(bucket), max(bucket), INTERVAL 7 DAY)) AS DATE) AS bucket FROM ew GROUP BY 1) s
  LEFT JOIN ew w ON w.series_id = s.series_id AND w.bucket = s.bucket""", "ew AS (SELECT event_type AS series_id, CAST(CAST(ts AS DATE) + CAST((5 - isodow(ts) + 7) % 7 AS INTEGER) AS DATE) AS bucket, sum(round(value)) AS y FROM events GROUP BY 1, 2)")  # fmt: skip
def events_weekly(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series_id"), F.to_date("ts").alias("ds")).agg(F.sum(F.round("value")).alias("y"))
    return pn.resample(rows, "weekly")


_RAW = """rawp AS (SELECT d.series_id, d.ds, d.is_reported, CASE WHEN c.is_bday = 1 THEN d.y ELSE coalesce(d.y, 0.0) END AS y, c.is_bday FROM daysp d JOIN cal c ON c.ds = d.ds),
imp AS (SELECT r.*, (SELECT median(v) FROM (SELECT o.y AS v FROM rawp o WHERE o.series_id = r.series_id AND isodow(o.ds) = isodow(r.ds) AND o.is_bday = 1 AND o.y IS NOT NULL AND o.ds < r.ds ORDER BY o.ds DESC LIMIT 8)) AS med FROM rawp r WHERE r.y IS NULL AND r.is_bday = 1)"""


@query("causal_impute", """SELECT r.series_id, r.ds, CASE WHEN i.ds IS NULL THEN r.y ELSE i.med END AS clean, i.med IS NOT NULL AS imputed FROM rawp r LEFT JOIN imp i ON i.series_id = r.series_id AND i.ds = r.ds""", PANEL, DAYS, CAL, _RAW)
def causal_impute(spark, sf_dir):
    cal = cal_fn.calendar(spark, 1995, 2001)
    rows = pn.daily_reindex(order_panel(spark, sf_dir)).join(F.broadcast(cal.select("ds", "is_bday")), "ds")
    rows = rows.withColumn("y", F.when(F.col("is_bday") == 1, F.col("y")).otherwise(F.coalesce("y", F.lit(0.0))))
    return clean.causal_impute(rows).select("series_id", "ds", "clean", "imputed")


@query("cleaning_variants", """SELECT variant, series_id, count(*) AS n, count(y) AS n_known, sum(y) AS total FROM (
  SELECT 'raw' AS variant, series_id, y FROM rawp UNION ALL SELECT 'conservative', series_id, coalesce(y, 0.0) FROM daysp
  UNION ALL SELECT 'treasury', r.series_id, CASE WHEN i.ds IS NULL THEN r.y ELSE i.med END FROM rawp r LEFT JOIN imp i ON i.series_id = r.series_id AND i.ds = r.ds) GROUP BY 1, 2""", PANEL, DAYS, CAL, _RAW)  # fmt: skip
def cleaning_variants(spark, sf_dir):
    out = clean.variants(order_panel(spark, sf_dir), cal_fn.calendar(spark, 1995, 2001))
    return out.groupBy("variant", "series_id").agg(F.count("*").alias("n"), F.count("y").alias("n_known"), F.sum("y").alias("total"))


@query("validity_report", """SELECT series_id, count(*) FILTER (y < 0) AS n_negative, count(*) FILTER (b > 0 AND y > 1.5 * b) AS n_jumps, string_agg(CAST(ds AS VARCHAR) || ' ' || CAST(CAST(y AS BIGINT) AS VARCHAR) || ' ' || CAST(CAST(b AS BIGINT) AS VARCHAR), ';' ORDER BY ds) FILTER (jump AND nth <= 3) AS jumps
  FROM (SELECT *, b > 0 AND y > 1.5 * b AS jump, count(*) FILTER (b > 0 AND y > 1.5 * b) OVER (PARTITION BY series_id ORDER BY ds) AS nth FROM (SELECT p.*, max(abs(y)) OVER (PARTITION BY series_id ORDER BY p.ds ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM moves p JOIN cal ON cal.ds = p.ds AND cal.is_bday = 1 WHERE y IS NOT NULL)) GROUP BY 1""", PANEL, "moves AS (SELECT series_id, ds, y - lag(y) OVER (PARTITION BY series_id ORDER BY ds) AS y FROM panel)", CAL)  # fmt: skip
def validity_report(spark, sf_dir):
    """Changes from day to day, which are of either sign; jumps over half as much again as any before, the first three."""
    moves = pn.first_difference(order_panel(spark, sf_dir)).select("series_id", "ds", F.col("diff").alias("y"))
    out = clean.validity_report(moves, cal_fn.calendar(spark, 1995, 2001), 1.5, 3)
    shown = F.transform("jumps", lambda x: F.concat_ws(" ", x["date"].cast("string"), x["value"].cast("long").cast("string"), x["prior_max"].cast("long").cast("string")))
    return out.select("series_id", "n_negative", "n_jumps", F.nullif(F.array_join(shown, ";"), F.lit("")).alias("jumps"))


@query("clip_mad", """SELECT b.series_id, b.ds, round(greatest(least(y, CASE WHEN mad > 0 THEN med + 1.4826 * 6 * mad ELSE p99 END), CASE WHEN mad > 0 THEN med - 1.4826 * 6 * mad ELSE -p99 END), 4) AS clipped FROM biz b
  JOIN (SELECT x.series_id, any_value(m.med) AS med, any_value(m.p99) AS p99, median(abs(x.y - m.med)) AS mad FROM biz x JOIN (SELECT series_id, median(y) AS med, quantile_cont(abs(y), 0.99) AS p99 FROM biz GROUP BY 1) m ON m.series_id = x.series_id GROUP BY 1) s
  ON s.series_id = b.series_id""", *BUSINESS)  # fmt: skip
def clip_mad(spark, sf_dir):
    return clean.clip_mad(business_panel(spark, sf_dir)).select("series_id", "ds", F.round("clipped", 4).alias("clipped"))


@query("coverage_counters", "SELECT series_id, count(*) AS n_rows, count(*) FILTER (is_reported) AS n_reported, count(*) FILTER (is_reported AND y IS NULL) AS n_blank, count(*) FILTER (y = 0) AS n_zero, round(count(*) FILTER (is_reported) / count(*), 6) AS coverage FROM daysp GROUP BY 1", PANEL, DAYS)
def coverage_counters(spark, sf_dir):
    return clean.coverage_counters(pn.daily_reindex(order_panel(spark, sf_dir))).withColumn("coverage", F.round("coverage", 6))


@query("assertions", """SELECT rule, violations, allowed, violations <= allowed AS holds FROM (SELECT 'daily_continuity' AS rule, count(*) FILTER (gap > 1) AS violations, 0 AS allowed FROM g UNION ALL SELECT 'repeated_days', count(*) FILTER (gap = 0), 0 FROM g
  UNION ALL SELECT 'weekend_flag', count(*) FILTER (is_weekend IS NULL OR (isodow(ds) >= 6) <> (is_weekend = 1)), 0 FROM g UNION ALL SELECT 'holiday_flag', count(*) FILTER (is_holiday IS NULL OR is_holiday NOT IN (0, 1)), 0 FROM g
  UNION ALL SELECT 'known_holidays', count(*) FILTER (is_holiday <> 1 AND ds IN (DATE '1996-04-14', DATE '2000-04-28', DATE '2000-05-01', DATE '1998-01-01', DATE '2000-06-01')), 0 FROM g UNION ALL SELECT 'known_workdays', count(*) FILTER (is_holiday <> 0 AND ds IN (DATE '2000-04-21', DATE '2000-04-24', DATE '1999-05-12')), 0 FROM g
  UNION ALL SELECT 'missing_business_days', count(DISTINCT ds) FILTER (y IS NULL AND is_weekend = 0 AND is_holiday = 0), 100 FROM g UNION ALL SELECT 'nonzero_other_days', count(*) FILTER (y <> 0 AND NOT (is_weekend = 0 AND is_holiday = 0)), 0 FROM g)""", PANEL, DAYS, CAL,
  "g AS (SELECT d.*, c.is_weekend, c.is_holiday, d.ds - lag(d.ds) OVER (PARTITION BY d.series_id ORDER BY d.ds) AS gap FROM daysp d LEFT JOIN cal c ON c.ds = d.ds)")
def assertions(spark, sf_dir):
    """Known days hold one of each sort that the calendar calls otherwise; orders come on all days of the week."""
    flags = cal_fn.calendar(spark, 1995, 2001).select("ds", "is_weekend", "is_holiday")
    rows = pn.daily_reindex(order_panel(spark, sf_dir)).join(F.broadcast(flags), "ds", "left")
    return clean.assertions(rows, clean.rules(["1996-04-14", "2000-04-28", "2000-05-01", "1998-01-01", "2000-06-01"], ["2000-04-21", "2000-04-24", "1999-05-12"], 100))


@query("compare_panels", """SELECT coalesce(a.series_id, b.series_id) AS series_id, count(*) FILTER (a.y IS NOT NULL AND b.y IS NOT NULL) AS n_common, count(*) FILTER ((a.y IS NULL) <> (b.y IS NULL)) AS n_one_side, max(abs(a.y - b.y)) AS max_diff, round(avg(abs(a.y - b.y)), 4) AS mean_diff,
  count(*) FILTER (abs(a.y - b.y) > 1e-9) AS n_diff FROM panel a FULL JOIN pf b ON b.series_id = a.series_id AND b.ds = a.ds GROUP BY 1""", PANEL, "pf AS (SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS ds, SUM(round(o_totalprice)) AS y FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2)")  # fmt: skip
def compare_panels(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("ds")).agg(F.sum(F.round("o_totalprice")).alias("y"))
    return clean.compare(order_panel(spark, sf_dir), done).withColumn("mean_diff", F.round("mean_diff", 4))


@query("normalise_ledger", """SELECT s.series_id, s.ds, p.net_flow FROM (SELECT series_id, CAST(unnest(generate_series(min(ds), max(ds), INTERVAL 1 DAY)) AS DATE) AS ds FROM lg GROUP BY 1) s LEFT JOIN lg p ON p.series_id = s.series_id AND p.ds = s.ds""",
       "lg AS (SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS ds, sum(CASE WHEN o_orderstatus = 'F' THEN round(o_totalprice) ELSE 0 END) - sum(CASE WHEN o_orderstatus <> 'F' THEN round(o_totalprice) ELSE 0 END) AS net_flow FROM orders GROUP BY 1, 2)")
def normalise_ledger(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("Series_ID"), F.to_date("o_orderdate").alias("DS"))
    rows = rows.agg(F.sum(F.when(F.col("o_orderstatus") == "F", F.round("o_totalprice")).otherwise(0.0)).alias(" Inflow"), F.sum(F.when(F.col("o_orderstatus") != "F", F.round("o_totalprice")).otherwise(0.0)).alias("Outflow "))
    return pn.normalise_ledger(rows)


@query("missing_days", "SELECT series_id, ds FROM daysp EXCEPT SELECT series_id, ds FROM panel", PANEL, DAYS)
def missing_days(spark, sf_dir):
    panel = order_panel(spark, sf_dir)
    return pn.spine(panel, False).select("series_id", "ds").exceptAll(panel.select("series_id", "ds"))


@query("common_days", "SELECT ds FROM panel WHERE series_id = '1-URGENT' INTERSECT SELECT ds FROM panel WHERE series_id = '5-LOW'", PANEL)
def common_days(spark, sf_dir):
    panel = order_panel(spark, sf_dir)
    return panel.where("series_id = '1-URGENT'").select("ds").intersect(panel.where("series_id = '5-LOW'").select("ds"))


@query("name_slugs", "SELECT o_orderpriority AS name, regexp_replace(regexp_replace(lower(trim(o_orderpriority)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, count(*) AS n FROM orders GROUP BY 1, 2")
def name_slugs(spark, sf_dir):
    from ..operators.features import name_slug

    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(F.count("*").alias("n")).select("name", name_slug("name").alias("slug"), "n")
