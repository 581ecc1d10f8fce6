"""Queries of backward-only features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal_fn
from ..operators import baselines, features as ft, panel as pn
from .registry import BUSINESS, CAL, PANEL, business_panel, order_panel, query


def rounded(df, digits: int, *names: str):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("lag_features", "SELECT series_id, pos, y, lag(y, 1) OVER w AS lag_1, lag(y, 2) OVER w AS lag_2, lag(y, 5) OVER w AS lag_5, lag(y, 20) OVER w AS lag_20 FROM biz WINDOW w AS (PARTITION BY series_id ORDER BY pos)", *BUSINESS)
def lag_features(spark, sf_dir):
    return ft.lags(business_panel(spark, sf_dir), [1, 2, 5, 20]).drop("ds", "is_reported")


@query("trailing_features", """SELECT series_id, pos, round(avg(y) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 4) AS mean_5, round(stddev_pop(y) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 3) AS std_5,
  round(avg(y) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 4) AS mean_20, round(stddev_pop(y) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 3) AS std_20 FROM biz""", *BUSINESS)  # fmt: skip
def trailing_features(spark, sf_dir):
    out = ft.trailing(business_panel(spark, sf_dir), [5, 20])
    return rounded(rounded(out, 4, "mean_5", "mean_20"), 3, "std_5", "std_20").select("series_id", "pos", "mean_5", "std_5", "mean_20", "std_20")


def _robust(w: int) -> str:
    over = f"OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count(y) {over} >= {max(2, w // 3)} THEN round(quantile_cont(y, 0.5) {over}, 4) END AS med_{w}, CASE WHEN count(y) {over} >= {max(2, w // 3)} THEN max(y) {over} END AS max_{w}, CASE WHEN count(y) {over} >= {max(2, w // 3)} THEN round(quantile_cont(y, 0.9) {over}, 4) END AS q90_{w}"


@query("robust_features", f"SELECT series_id, pos, {_robust(5)}, {_robust(21)}, {_robust(63)} FROM biz", *BUSINESS)
def robust_features(spark, sf_dir):
    out = ft.robust_trailing(business_panel(spark, sf_dir))
    return rounded(out, 4, *[f"{n}_{w}" for n in ("med", "q90") for w in (5, 21, 63)]).drop("ds", "y", "is_reported")


def _ewm(h: int) -> str:
    return f"(SELECT CASE WHEN count(*) >= 2 THEN round(sum(pow(0.5, (b.pos - x.pos) / {h}.0) * x.y) / sum(pow(0.5, (b.pos - x.pos) / {h}.0)), 2) END FROM biz x WHERE x.series_id = b.series_id AND x.pos < b.pos) AS ewm_{h}"


@query("ewma_features", f"SELECT b.series_id, b.pos, {_ewm(5)}, {_ewm(21)} FROM biz b", *BUSINESS)
def ewma_features(spark, sf_dir):
    return rounded(ft.ewma(business_panel(spark, sf_dir)), 2, "ewm_5", "ewm_21").select("series_id", "pos", "ewm_5", "ewm_21")


@query("weekday_dummies", "SELECT series_id, pos, " + ", ".join(f"CAST(isodow(ds) - 1 = {k} AS INTEGER) AS dow_{k}" for k in range(1, 5)) + " FROM biz", *BUSINESS)
def weekday_dummies(spark, sf_dir):
    rows = business_panel(spark, sf_dir).withColumn("dow", F.weekday("ds"))
    return rows.withColumns(ft.weekday_dummies()).select("series_id", "pos", *[f"dow_{k}" for k in range(1, 5)])


@query("weekday_rolling", "SELECT series_id, pos, round(avg(y) OVER (PARTITION BY series_id, isodow(ds) ORDER BY pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), 4) AS dow_mean FROM biz", *BUSINESS)
def weekday_rolling(spark, sf_dir):
    return rounded(ft.weekday_rolling(business_panel(spark, sf_dir)), 4, "dow_mean").select("series_id", "pos", "dow_mean")


@query("z_scores", """SELECT series_id, pos, round(z, 5) AS z, coalesce(abs(z) > 4, false) AS is_outlier FROM (SELECT series_id, pos, CASE WHEN n >= 20 AND sd > 0 THEN (y - m) / sd END AS z FROM (
  SELECT *, count(y) OVER w AS n, avg(y) OVER w AS m, stddev_samp(y) OVER w AS sd FROM biz WINDOW w AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)))""", *BUSINESS)  # fmt: skip
def z_scores(spark, sf_dir):
    return rounded(ft.z_scores(business_panel(spark, sf_dir)), 5, "z").select("series_id", "pos", "z", "is_outlier")


_ALIGNED = """place AS (SELECT ds, row_number() OVER (PARTITION BY date_trunc('month', ds) ORDER BY ds) AS bdom FROM cal WHERE is_weekend = 0),
al AS (SELECT b.series_id, b.pos, year(b.ds) * 12 + month(b.ds) AS m, p.bdom, lag(b.y) OVER (PARTITION BY b.series_id ORDER BY b.pos) AS safe FROM biz b JOIN place p ON p.ds = b.ds)"""


@query("aligned_lags", """SELECT a.series_id, a.pos, p.safe AS y_prev_month, q.safe AS y_prev_year FROM al a LEFT JOIN al p ON p.series_id = a.series_id AND p.m = a.m - 1 AND p.bdom = a.bdom AND p.pos < a.pos
  LEFT JOIN al q ON q.series_id = a.series_id AND q.m = a.m - 12 AND q.bdom = a.bdom AND q.pos < a.pos""", *BUSINESS, CAL, _ALIGNED)  # fmt: skip
def aligned_lags(spark, sf_dir):
    place = cal_fn.month_position(cal_fn.calendar(spark, 1995, 2001))
    return ft.aligned_lags(business_panel(spark, sf_dir), place).select("series_id", "pos", "y_prev_month", "y_prev_year")


@query("exogenous_ranking", """SELECT series_id, round(corr, 5) AS corr, CAST(row_number() OVER (ORDER BY abs(corr) DESC NULLS LAST, series_id) AS INTEGER) AS rank FROM (
  SELECT b.series_id, corr(b.y, t.y) AS corr FROM biz b JOIN biz t ON t.ds = b.ds AND t.series_id = '1-URGENT' WHERE b.series_id <> '1-URGENT' AND b.ds <= DATE '1999-12-31' AND t.ds <= DATE '1999-12-31' GROUP BY 1)""", *BUSINESS)  # fmt: skip
def exogenous_ranking(spark, sf_dir):
    train = business_panel(spark, sf_dir).where("ds <= DATE '1999-12-31'")
    return rounded(ft.exogenous_ranking(train, "1-URGENT", 10), 5, "corr").select("series_id", "corr", F.col("rank").cast("int").alias("rank"))


@query("sequences", """SELECT series_id, pos, list_sum(w) AS window_sum, w[1] AS first_value, target FROM (SELECT series_id, pos, list(y) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 63 PRECEDING AND CURRENT ROW) AS w, lead(y, 5) OVER (PARTITION BY series_id ORDER BY pos) AS target FROM biz)
  WHERE len(w) = 64 AND target IS NOT NULL""", *BUSINESS)  # fmt: skip
def sequences(spark, sf_dir):
    out = ft.sequences(business_panel(spark, sf_dir), 64, 5)
    return out.select("series_id", "pos", F.aggregate("window", F.lit(0.0), lambda a, x: a + x).alias("window_sum"), F.get("window", F.lit(0)).alias("first_value"), "target")


@query("horizon_target", "SELECT series_id, pos, lead(ds, 5) OVER w AS target_date, lead(y, 5) OVER w - y AS target FROM biz WINDOW w AS (PARTITION BY series_id ORDER BY pos)", *BUSINESS)
def horizon_target(spark, sf_dir):
    return pn.horizon_target(business_panel(spark, sf_dir), 5, True).select("series_id", "pos", "target_date", "target")


@query("log_standardise", """SELECT b.series_id, b.pos, round((ln(1 + greatest(y, 0.0)) - mu) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 6) AS z, round(y, 0) AS back FROM biz b
  JOIN (SELECT series_id, avg(ln(1 + greatest(y, 0.0))) AS mu, stddev_pop(ln(1 + greatest(y, 0.0))) AS sd FROM biz WHERE ds <= DATE '1999-12-31' GROUP BY 1) s ON s.series_id = b.series_id""", *BUSINESS)  # fmt: skip
def log_standardise(spark, sf_dir):
    out = ft.log_standardise(business_panel(spark, sf_dir), F.col("ds") <= F.lit("1999-12-31").cast("date"))
    return out.select("series_id", "pos", F.round("z", 6).alias("z"), F.round("back", 0).alias("back"))


@query("feature_joins", """SELECT b.series_id, b.ds, b.y, lag(b.y) OVER (PARTITION BY b.series_id ORDER BY pos) AS lag_1, c.is_holiday, round(x.y, 4) AS shipped FROM biz b JOIN cal c ON c.ds = b.ds
  LEFT JOIN (SELECT CAST(l_shipdate AS DATE) AS ds, sum(round(l_extendedprice)) AS y FROM lineitem GROUP BY 1) x ON x.ds = b.ds""", *BUSINESS, CAL)  # fmt: skip
def feature_joins(spark, sf_dir):
    cal = cal_fn.calendar(spark, 1995, 2001).select("ds", "is_holiday")
    shipped = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.to_date("l_shipdate").alias("ds")).agg(F.sum(F.round("l_extendedprice")).alias("shipped"))
    rows = ft.lags(business_panel(spark, sf_dir), [1]).join(F.broadcast(cal), "ds").join(shipped, "ds", "left")
    return rounded(rows, 4, "shipped").select("series_id", "ds", "y", "lag_1", "is_holiday", "shipped")


@query("feature_hashes", "SELECT c AS \"group\", sha256(string_agg(DISTINCT name, chr(10) ORDER BY name)) AS hash FROM (SELECT c_mktsegment AS c, c_name AS name FROM customer) GROUP BY 1")
def feature_hashes(spark, sf_dir):
    names = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_mktsegment").alias("group"), F.col("c_name").alias("name")).distinct()
    return ft.feature_set_hash(names)


@query("block_selection", "SELECT series_id, ds, y FROM panel WHERE series_id IN ('1-URGENT', '2-HIGH') AND ds BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'", PANEL)
def block_selection(spark, sf_dir):
    return order_panel(spark, sf_dir).where(F.col("series_id").isin("1-URGENT", "2-HIGH") & F.col("ds").between("1998-01-01", "1998-12-31"))


@query("customer_panel_features", """SELECT series_id, ds, y, lag(y) OVER w AS lag_1, round(avg(y) OVER (PARTITION BY series_id ORDER BY ds ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 4) AS mean_5, CAST(row_number() OVER w - 1 AS INTEGER) AS pos
  FROM (SELECT CAST(o_custkey AS VARCHAR) AS series_id, CAST(o_orderdate AS DATE) AS ds, sum(round(o_totalprice)) AS y FROM orders GROUP BY 1, 2) WINDOW w AS (PARTITION BY series_id ORDER BY ds)""")  # fmt: skip
def customer_panel_features(spark, sf_dir):
    """The scale case: as many series as customers; one shuffle by series serves all windows."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").cast("string").alias("series_id"), F.to_date("o_orderdate").alias("ds")).agg(F.sum(F.round("o_totalprice")).alias("y"))
    w = pn.by_series("ds")
    return rows.select("series_id", "ds", "y", F.lag("y").over(w).alias("lag_1"), F.round(F.avg("y").over(w.rowsBetween(-5, -1)), 4).alias("mean_5"), (F.row_number().over(w) - 1).cast("int").alias("pos"))


@query("weekday_profile", "SELECT series_id, CAST(isodow(ds) - 1 AS INTEGER) AS dow, round(avg(y), 4) AS mean, count(*) AS n FROM biz GROUP BY 1, 2", *BUSINESS)
def weekday_profile(spark, sf_dir):
    return rounded(baselines.weekday_profile(business_panel(spark, sf_dir)), 4, "mean")


@query("kpis", """SELECT series_id, max_by(y, ds) AS last_value, round(avg(y) FILTER (r <= 30), 4) AS mean_30, round(stddev_samp(y) FILTER (r <= 90), 3) AS std_90 FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds DESC) AS r FROM biz) GROUP BY 1""", *BUSINESS)
def kpis(spark, sf_dir):
    return rounded(rounded(baselines.kpis(business_panel(spark, sf_dir)), 4, "mean_30"), 3, "std_90")


@query("one_step_backtest", """SELECT series_id, round(avg(abs(y - nv)), 4) AS naive_mae, round(avg(abs(y - ma)), 4) AS ma_mae FROM (SELECT *, lag(y) OVER (PARTITION BY series_id ORDER BY pos) AS nv, avg(y) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS ma,
  row_number() OVER (PARTITION BY series_id ORDER BY pos DESC) AS r FROM biz) WHERE r <= 30 GROUP BY 1""", *BUSINESS)  # fmt: skip
def one_step_backtest(spark, sf_dir):
    return rounded(baselines.one_step_backtest(business_panel(spark, sf_dir)), 4, "naive_mae", "ma_mae")


_MONTHLY = """mo AS (SELECT series_id, CAST(year(ds) AS INTEGER) AS year, CAST(month(ds) AS INTEGER) AS month, sum(y) AS total FROM biz GROUP BY 1, 2, 3),
yr AS (SELECT series_id, year, sum(total) AS yt FROM mo GROUP BY 1, 2 HAVING count(*) = 12),
mb0 AS (SELECT m.series_id, m.year, m.month, m.total, count(y.yt) AS k, avg(y.yt) AS a, avg(CASE WHEN y.yt > 0 THEN p.total / y.yt END) AS s FROM mo m LEFT JOIN mo p ON p.series_id = m.series_id AND p.month = m.month AND p.year BETWEEN m.year - 3 AND m.year - 1
  LEFT JOIN yr y ON y.series_id = p.series_id AND y.year = p.year GROUP BY 1, 2, 3, 4),
mb AS (SELECT series_id, year, month, total, last_value(CASE WHEN k = 3 THEN a * s END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY year, month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS baseline, nullif(k, 0) AS n_years FROM mb0)"""


@query("ops_monthly_baseline", "SELECT series_id, year, month, total, round(baseline, 2) AS baseline, n_years FROM mb", *BUSINESS, _MONTHLY)
def ops_monthly_baseline(spark, sf_dir):
    return rounded(baselines.monthly_baseline(business_panel(spark, sf_dir)), 2, "baseline")


@query("same_month_mean", "SELECT series_id, year, month, total, round(avg(total) OVER (PARTITION BY series_id, month ORDER BY year ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 4) AS fallback FROM mo", *BUSINESS, _MONTHLY)
def same_month_mean(spark, sf_dir):
    return rounded(baselines.same_month_mean(business_panel(spark, sf_dir)), 4, "fallback")


_SPREAD = """sp0 AS (SELECT series_id, ds, y, CAST(year(ds) AS INTEGER) AS year, CAST(month(ds) AS INTEGER) AS month, day(ds) AS dom, CASE WHEN sum(y) OVER (PARTITION BY series_id, year(ds), month(ds)) <> 0 THEN y / sum(y) OVER (PARTITION BY series_id, year(ds), month(ds)) END AS share FROM biz),
sp1 AS (SELECT a.series_id, a.ds, a.y, a.year, a.month, coalesce((SELECT avg(o.share) FROM sp0 o WHERE o.series_id = a.series_id AND o.month = a.month AND o.dom = a.dom AND o.year BETWEEN a.year - 3 AND a.year - 1), 0) AS w FROM sp0 a),
sp2 AS (SELECT *, sum(w) OVER (PARTITION BY series_id, year, month) AS t, count(*) OVER (PARTITION BY series_id, year, month) AS n FROM sp1)"""


@query("ops_daily_baseline", "SELECT s.series_id, s.ds, s.y, round(m.baseline * CASE WHEN t > 0 THEN w / t ELSE 1.0 / n END, 2) AS baseline FROM sp2 s LEFT JOIN mb m ON m.series_id = s.series_id AND m.year = s.year AND m.month = s.month", *BUSINESS, _MONTHLY, _SPREAD)
def ops_daily_baseline(spark, sf_dir):
    panel = business_panel(spark, sf_dir)
    return rounded(baselines.spread_month(panel, baselines.monthly_baseline(panel)), 2, "baseline")


@query("ops_daily_average", """SELECT s.series_id, s.ds, s.y, round(m.baseline * CASE WHEN coalesce(t, 0) <> 0 THEN v / t ELSE 1.0 / n END, 2) AS baseline FROM (SELECT *, sum(v) OVER (PARTITION BY series_id, year(ds), month(ds)) AS t, count(*) OVER (PARTITION BY series_id, year(ds), month(ds)) AS n FROM
  (SELECT b.series_id, b.ds, b.y, avg(o.y) AS v FROM biz b LEFT JOIN biz o ON o.series_id = b.series_id AND o.ds IN (CAST(b.ds - INTERVAL 1 YEAR AS DATE), CAST(b.ds - INTERVAL 2 YEAR AS DATE), CAST(b.ds - INTERVAL 3 YEAR AS DATE)) GROUP BY 1, 2, 3)) s
  LEFT JOIN mb m ON m.series_id = s.series_id AND m.year = year(s.ds) AND m.month = month(s.ds)""", *BUSINESS, _MONTHLY)  # fmt: skip
def ops_daily_average(spark, sf_dir):
    panel = business_panel(spark, sf_dir)
    return rounded(baselines.spread_month(panel, baselines.monthly_baseline(panel), method="average"), 2, "baseline")


@query("iso_week_pivot", "SELECT CAST(weekofyear(ds) AS INTEGER) AS week, " + ", ".join(f"sum(y) FILTER (isodow(ds) = {k + 1}) AS d{k}" for k in range(5)) + " FROM biz GROUP BY 1", *BUSINESS)
def iso_week_pivot(spark, sf_dir):
    rows = business_panel(spark, sf_dir).select(F.weekofyear("ds").alias("week"), F.concat(F.lit("d"), F.weekday("ds")).alias("d"), "y")
    return rows.groupBy("week").pivot("d", [f"d{k}" for k in range(5)]).agg(F.sum("y"))


@query("frequency", "SELECT series_id, mode(ds - p) AS step_days FROM (SELECT series_id, ds, lag(ds) OVER (PARTITION BY series_id ORDER BY ds) AS p FROM biz) GROUP BY 1", *BUSINESS)
def frequency(spark, sf_dir):
    gap = F.datediff("ds", F.lag("ds").over(pn.by_series("ds")))
    return business_panel(spark, sf_dir).withColumn("gap", gap).groupBy("series_id").agg(F.mode("gap", True).cast("long").alias("step_days"))
