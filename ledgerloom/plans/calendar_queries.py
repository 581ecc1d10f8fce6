"""Queries of the business calendar over the span of the order dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as cal_fn
from ..operators import panel as pn
from .registry import BUSINESS, CAL, DAYS, END, PANEL, START, business_panel, order_panel, query


def _cal(spark: SparkSession) -> DataFrame:
    return cal_fn.calendar(spark, 1995, 2001)


def _on_orders(spark: SparkSession, sf_dir: str, features: DataFrame, *sums: str) -> DataFrame:
    """A calendar table meets the days on which orders came, by broadcast."""
    days = order_panel(spark, sf_dir).groupBy("ds").agg(F.sum("y").alias("y"))
    return days.join(F.broadcast(features), "ds")


_DAYSUM = "dsum AS (SELECT ds, SUM(y) AS y FROM panel GROUP BY 1)"


@query("holiday_membership", "SELECT p.series_id, p.ds, p.y, CAST(h.ds IS NOT NULL AS INTEGER) AS is_holiday FROM panel p LEFT JOIN hols h ON h.ds = p.ds", PANEL, CAL)
def holiday_membership(spark, sf_dir):
    return pn.holiday_flag(order_panel(spark, sf_dir), cal_fn.holidays(spark, 1995, 2001)).select("series_id", "ds", "y", "is_holiday")


@query("easter_orders", "SELECT CAST(yr AS INTEGER) AS year, easter, coalesce((SELECT SUM(y) FROM panel WHERE ds BETWEEN easter - 3 AND easter + 3), 0.0) AS y FROM easters", PANEL, CAL)
def easter_orders(spark, sf_dir):
    easter = cal_fn.years(spark, 1995, 2001).withColumn("easter", cal_fn.orthodox_easter(F.col("year")))
    near = easter.join(order_panel(spark, sf_dir), F.col("ds").between(F.date_sub("easter", 3), F.date_add("easter", 3)), "left")
    return near.groupBy("year", "easter").agg(F.coalesce(F.sum("y"), F.lit(0.0)).alias("y"))


@query("calendar_on_orders", "SELECT d.ds, d.y, c.dow, c.is_weekend, c.is_holiday, c.is_bday, c.bpos FROM dsum d JOIN cal c ON c.ds = d.ds", PANEL, _DAYSUM, CAL)
def calendar_on_orders(spark, sf_dir):
    return _on_orders(spark, sf_dir, _cal(spark)).select("ds", "y", "dow", "is_weekend", "is_holiday", "is_bday", "bpos")


_SHIFT = "shifted AS (SELECT ds, min(CASE WHEN is_bday = 1 THEN ds END) OVER (ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS shifted FROM cal)"
_DUE = """due AS (SELECT 'monthly_15' AS kind, ds AS nominal, shifted AS ds FROM shifted WHERE day(ds) = 15
  UNION ALL SELECT 'annual', ds, shifted FROM shifted WHERE month(ds) = 11 AND day(ds) IN (1, 15))"""


@query("deadline_orders", "SELECT d.kind, d.nominal, d.ds, coalesce(s.y, 0.0) AS y FROM due d LEFT JOIN dsum s ON s.ds = d.ds WHERE d.ds IS NOT NULL", PANEL, _DAYSUM, CAL, _SHIFT, _DUE)
def deadline_orders(spark, sf_dir):
    days = order_panel(spark, sf_dir).groupBy("ds").agg(F.sum("y").alias("y"))
    return cal_fn.deadlines(_cal(spark)).join(days, "ds", "left").select("kind", "nominal", "ds", F.coalesce("y", F.lit(0.0)).alias("y"))


_DEADLINE = """dl0 AS (SELECT c.ds, coalesce(max(CASE WHEN d.kind = 'monthly_15' THEN 1 END), 0) AS m, coalesce(max(CASE WHEN d.kind = 'annual' THEN 1 END), 0) AS a
  FROM cal c LEFT JOIN due d ON d.ds = c.ds WHERE c.is_weekend = 0 GROUP BY 1),
dl1 AS (SELECT *, row_number() OVER (ORDER BY ds) AS p FROM dl0),
dl2 AS (SELECT *, min(CASE WHEN m = 1 THEN p END) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nx, max(CASE WHEN m = 1 THEN p END) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pv FROM dl1),
dl AS (SELECT x.ds, m AS is_deadline_monthly, a AS is_deadline_annual, greatest(m, a) AS is_deadline_any, CAST(coalesce(least(nx - p, 10), 10) AS INTEGER) AS bdays_to_deadline, CAST(coalesce(least(p - pv, 10), 10) AS INTEGER) AS bdays_since_deadline,
  CAST(u.ds - u.nominal AS INTEGER) AS deadline_shift_days FROM dl2 x LEFT JOIN due u ON u.kind = 'monthly_15' AND date_trunc('month', u.nominal) = date_trunc('month', x.ds))"""


@query("deadline_features", "SELECT s.y, f.* FROM dl f JOIN dsum s ON s.ds = f.ds", PANEL, _DAYSUM, CAL, _SHIFT, _DUE, _DEADLINE)
def deadline_features(spark, sf_dir):
    return _on_orders(spark, sf_dir, cal_fn.deadline_features(_cal(spark), START, END))


_HOLIDAY = """hf0 AS (SELECT *, lag(is_bday) OVER (ORDER BY ds) AS pb, lead(is_bday) OVER (ORDER BY ds) AS nb,
  min(CASE WHEN is_holiday = 1 THEN ds END) OVER (ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nx, max(CASE WHEN is_holiday = 1 THEN ds END) OVER (ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pv FROM cal),
hf AS (SELECT f.ds, is_holiday, CAST(coalesce(least(nx - f.ds, 10), 10) AS INTEGER) AS days_to_holiday, CAST(coalesce(least(f.ds - pv, 10), 10) AS INTEGER) AS days_since_holiday,
  CAST(pb = 0 AND nb = 0 AND is_bday = 1 AS INTEGER) AS is_bridge_day, CAST(greatest(-10, least(10, f.ds - e.easter)) AS INTEGER) AS days_from_easter, CAST(abs(greatest(-10, least(10, f.ds - e.easter))) <= 3 AS INTEGER) AS in_easter_week
  FROM hf0 f JOIN easters e ON e.yr = year(f.ds) WHERE is_weekend = 0)"""


@query("holiday_features", "SELECT s.y, f.* FROM hf f JOIN dsum s ON s.ds = f.ds", PANEL, _DAYSUM, CAL, _HOLIDAY)
def holiday_features(spark, sf_dir):
    return _on_orders(spark, sf_dir, cal_fn.holiday_features(_cal(spark), START, END))


_PERIOD = """pf AS (SELECT ds, CASE WHEN is_bday = 0 THEN 0 ELSE least(max(bpos) OVER (PARTITION BY date_trunc('month', ds)) - bpos, 25) END AS bdays_to_eom,
  CASE WHEN is_bday = 0 THEN 0 ELSE least(max(bpos) OVER (PARTITION BY date_trunc('quarter', ds)) - bpos, 70) END AS bdays_to_eoq,
  CASE WHEN is_bday = 0 THEN 0 ELSE least(max(bpos) OVER (PARTITION BY date_trunc('year', ds)) - bpos, 260) END AS bdays_to_eoy,
  CAST((day(ds) - 1) // 7 + 1 AS INTEGER) AS week_of_month, CAST(month(ds) AS INTEGER) AS month, dow, is_weekend FROM cal)"""


@query("period_features", "SELECT s.ds, s.y, bdays_to_eom, bdays_to_eoq, bdays_to_eoy, week_of_month, month, dow FROM pf f JOIN dsum s ON s.ds = f.ds WHERE is_weekend = 0", PANEL, _DAYSUM, CAL, _PERIOD)
def period_features(spark, sf_dir):
    return _on_orders(spark, sf_dir, cal_fn.period_features(_cal(spark), START, END))


@query(
    "date_parts",
    """SELECT ds, y, CAST(isodow(ds) - 1 AS INTEGER) AS dow, CAST(dayofyear(ds) AS INTEGER) AS doy, CAST(month(ds) AS INTEGER) AS month, CAST(day(ds) AS INTEGER) AS dom, CAST(quarter(ds) AS INTEGER) AS quarter, CAST(weekofyear(ds) AS INTEGER) AS week,
  CAST(month(ds + CASE WHEN isodow(ds) = 5 THEN 3 ELSE 1 END) <> month(ds) AS INTEGER) AS is_month_end, CAST(quarter(ds + CASE WHEN isodow(ds) = 5 THEN 3 ELSE 1 END) <> quarter(ds) AS INTEGER) AS is_quarter_end FROM dsum""",
    PANEL,
    _DAYSUM,
)
def date_parts(spark, sf_dir):
    days = order_panel(spark, sf_dir).groupBy("ds").agg(F.sum("y").alias("y"))
    return cal_fn.date_parts(days.select("ds")).join(days, "ds")


@query(
    "month_position",
    """SELECT p.series_id, p.ds, p.y, CAST(f.bdom AS INTEGER) AS bdom, CAST(f.bdom_rev AS INTEGER) AS bdom_rev FROM biz p JOIN (
  SELECT ds, row_number() OVER (PARTITION BY date_trunc('month', ds) ORDER BY ds) AS bdom, count(*) OVER (PARTITION BY date_trunc('month', ds)) - row_number() OVER (PARTITION BY date_trunc('month', ds) ORDER BY ds) AS bdom_rev FROM cal WHERE is_weekend = 0) f ON f.ds = p.ds""",
    *BUSINESS,
    CAL,
)
def month_position(spark, sf_dir):
    return business_panel(spark, sf_dir).join(F.broadcast(cal_fn.month_position(_cal(spark))), "ds").select("series_id", "ds", "y", "bdom", "bdom_rev")


@query(
    "coverage_gaps",
    """SELECT d.series_id, d.ds FROM daysp d WHERE isodow(d.ds) < 6 AND NOT EXISTS (SELECT 1 FROM hols h WHERE h.ds = d.ds)
  AND NOT EXISTS (SELECT 1 FROM panel p WHERE p.series_id = d.series_id AND p.ds = d.ds AND p.y IS NOT NULL)""",
    PANEL,
    DAYS,
    CAL,
)
def coverage_gaps(spark, sf_dir):
    return pn.coverage_gaps(order_panel(spark, sf_dir), _cal(spark))


@query(
    "future_dates",
    """SELECT o.origin, CAST(k.step AS INTEGER) AS step, (SELECT ds FROM (SELECT c.ds, row_number() OVER (ORDER BY c.ds) AS r FROM wide c WHERE c.ds > o.origin) t WHERE t.r = k.step) AS ds
  FROM (SELECT max(ds) AS origin FROM panel GROUP BY series_id UNION SELECT min(ds) FROM panel GROUP BY series_id) o, (SELECT unnest(generate_series(1, 10)) AS step) k""",
    PANEL,
    "wide AS (SELECT CAST(d AS DATE) AS ds FROM (SELECT unnest(generate_series(TIMESTAMP '1994-12-01', TIMESTAMP '2002-12-31', INTERVAL 1 DAY)) AS d) WHERE isodow(d) < 6)",
)
def future_dates(spark, sf_dir):
    ends = order_panel(spark, sf_dir).groupBy("series_id").agg(F.max("ds").alias("a"), F.min("ds").alias("b"))
    origins = ends.select(F.explode(F.array("a", "b")).alias("ds")).distinct()
    return cal_fn.future_business_days(_cal(spark), origins, 10)


_EVENTDIST = """ed AS (SELECT b.*, min(CASE WHEN h.ds IS NOT NULL THEN pos END) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nx,
  max(CASE WHEN h.ds IS NOT NULL THEN pos END) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pv FROM biz b LEFT JOIN hols h ON h.ds = b.ds)"""


@query("nearest_event", "SELECT series_id, ds, CAST(coalesce(least(nx - pos, 10), 10) AS INTEGER) AS to_next, CAST(coalesce(least(pos - pv, 10), 10) AS INTEGER) AS since FROM ed", *BUSINESS, CAL, _EVENTDIST)
def nearest_event(spark, sf_dir):
    rows = pn.holiday_flag(business_panel(spark, sf_dir), cal_fn.holidays(spark, 1995, 2001))
    return pn.event_distance(rows, F.col("is_holiday") == 1, 10).select("series_id", "ds", F.col("to_next").cast("int").alias("to_next"), F.col("since").cast("int").alias("since"))
