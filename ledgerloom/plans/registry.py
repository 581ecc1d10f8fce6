"""Query registry, the panels built from the given tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.baselines import window_forecasts
from ..operators.panel import business_index
from ..operators.work import work_folder  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Windows that fit the given tables.
WINDOWS = [("TRAIN", "1995-01-01", "1999-12-31"), ("DEV", "2000-01-01", "2000-12-31"), ("TEST", "2001-01-01", "2001-12-31")]
START, END = "1995-01-01", "2001-12-31"
HORIZON = 5


def query(name: str, sql: str | None = None, *parts: str):
    """Register a query; ``parts`` are common table expressions that ``sql`` reads."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"{name} is taken")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = ("WITH " + ",\n".join(parts) + "\n" + sql) if parts else sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order value by day and priority, in whole units so that sums are exact in any order."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("ds"), F.round("o_totalprice").alias("y"))
    return orders.groupBy("series_id", "ds").agg(F.sum("y").alias("y"))


def segment_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order value by day, for each nation and market segment: the panel with many series."""
    who = table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws("-", "c_nationkey", "c_mktsegment").alias("series_id"))
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("ds"), F.round("o_totalprice").alias("y"))
    return orders.join(who, F.col("o_custkey") == F.col("c_custkey")).groupBy("series_id", "ds").agg(F.sum("y").alias("y"))


def business_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return business_index(order_panel(spark, sf_dir))


def forecasts(spark: SparkSession, sf_dir: str, horizon: int = HORIZON, since: str = "1999-01-01") -> DataFrame:
    """Window forecasts for targets from ``since`` on."""
    out = window_forecasts(business_panel(spark, sf_dir), horizon)
    return out.where(F.col("target_date") >= F.lit(since).cast("date"))


PANEL = "panel AS (SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS ds, SUM(round(o_totalprice)) AS y FROM orders GROUP BY 1, 2)"
DAYS = """daysp AS (SELECT s.series_id, s.ds, p.y, p.series_id IS NOT NULL AS is_reported
  FROM (SELECT series_id, CAST(unnest(generate_series(min(ds), max(ds), INTERVAL 1 DAY)) AS DATE) AS ds FROM panel GROUP BY 1) s
  LEFT JOIN panel p ON p.series_id = s.series_id AND p.ds = s.ds)"""
BIZ = """biz AS (SELECT series_id, ds, CAST(row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS INTEGER) AS pos, is_reported, coalesce(y, 0.0) AS y
  FROM daysp WHERE isodow(ds) < 6)"""
PREDS = """prows AS (SELECT series_id, ds AS origin_date, isodow(ds) AS dw, y AS origin_value,
    lead(ds, 5) OVER w AS target_date, lead(y, 5) OVER w AS y_true,
    avg(y) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS ma,
    stddev_pop(y) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS sd,
    avg(y) OVER (PARTITION BY series_id, isodow(ds) ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS wm
  FROM biz WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
preds AS (SELECT series_id, model, 5 AS horizon, origin_date, target_date, origin_value, y_true, y_pred, y_pred - half AS y_lo, y_pred + half AS y_hi FROM (
    SELECT *, 'naive_last' AS model, origin_value AS y_pred, CAST(NULL AS DOUBLE) AS half FROM prows
    UNION ALL SELECT *, 'weekday_mean', wm, 1.96 * sd FROM prows
    UNION ALL SELECT *, 'moving_average_20', ma, 1.96 * sd FROM prows)
  WHERE y_true IS NOT NULL AND target_date >= DATE '1999-01-01')"""
CAL = """years AS (SELECT unnest(generate_series(1995, 2001)) AS yr),
easters AS (SELECT yr, make_date(yr, 4, 4) + CAST((19 * (yr % 19) + 16) % 30 + (2 * (yr % 4) + 4 * (yr % 7) + 6 * ((19 * (yr % 19) + 16) % 30)) % 7 - 1 AS INTEGER) AS easter FROM years),
hols AS (SELECT DISTINCT ds FROM (
  SELECT make_date(yr, m, d) AS ds FROM years, (VALUES (1,1),(1,2),(1,7),(1,19),(3,3),(3,8),(4,9),(5,9),(5,12),(5,26),(8,28),(10,14),(11,23)) f(m, d)
  UNION ALL SELECT easter + CAST(k AS INTEGER) FROM easters, (VALUES (-2),(-1),(0),(1)) g(k))),
cal0 AS (SELECT CAST(d AS DATE) AS ds FROM (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-12-31', INTERVAL 1 DAY)) AS d)),
cal1 AS (SELECT c.ds, CAST(isodow(c.ds) - 1 AS INTEGER) AS dow, CAST(isodow(c.ds) > 5 AS INTEGER) AS is_weekend, CAST(h.ds IS NOT NULL AS INTEGER) AS is_holiday FROM cal0 c LEFT JOIN hols h ON h.ds = c.ds),
cal AS (SELECT *, CAST(is_weekend = 0 AND is_holiday = 0 AS INTEGER) AS is_bday, CAST(sum(CASE WHEN is_weekend = 0 AND is_holiday = 0 THEN 1 ELSE 0 END) OVER (ORDER BY ds) AS INTEGER) AS bpos FROM cal1)"""
BUSINESS = (PANEL, DAYS, BIZ)
FORECASTS = (PANEL, DAYS, BIZ, PREDS)
SEGMENTS = "panel AS (SELECT concat_ws('-', c_nationkey, c_mktsegment) AS series_id, CAST(o_orderdate AS DATE) AS ds, SUM(round(o_totalprice)) AS y FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"
