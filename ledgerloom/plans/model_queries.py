"""Queries of fitted models. What a solver returns has no SQL; tests hold them to properties."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal_fn
from ..operators import folds, groups, metrics, models, runs
from .feature_queries import rounded
from .registry import BUSINESS, FORECASTS, HORIZON, business_panel, query, work_folder

#: The training end of queries that fit once and score nothing by fold.
TRAIN_END = date(1999, 12, 31)


def stored_panel(spark, sf_dir):
    """The business panel, written once: what is fitted reads its panel many times, and the orders only here."""
    return models.kept(business_panel(spark, sf_dir))


def yearly(panel):
    """``(fold_id, train_end, eval_start, eval_end)`` of all yearly folds over the panel's series: a row for each year."""
    own = folds.yearly_folds(panel).groupBy("fold_id").agg(F.max("train_end").alias("t"), F.min("eval_start").alias("a"), F.max("eval_end").alias("b"))
    return sorted(tuple(r) for r in own.collect())


def fitted(spark, sf_dir, names, **more):
    panel = stored_panel(spark, sf_dir)
    return models.fold_forecasts(panel, yearly(panel), HORIZON, names, **more)


def by_fold(panel, make):
    """Rows that ``make`` gives for each fold, with the fold's number."""
    return reduce(DataFrame.unionByName, [make(*dates).withColumn("fold_id", F.lit(fold_id)) for fold_id, *dates in yearly(panel)])


@query("linear_forecasts")
def linear_forecasts(spark, sf_dir):
    return fitted(spark, sf_dir, ["ridge", "lasso", "elastic_net"])


@query("forest_forecasts")
def forest_forecasts(spark, sf_dir):
    return fitted(spark, sf_dir, ["random_forest"])


@query("boosted_forecasts")
def boosted_forecasts(spark, sf_dir):
    return fitted(spark, sf_dir, ["boosted_l2", "boosted_l1"])


@query("delta_forecasts")
def delta_forecasts(spark, sf_dir):
    return fitted(spark, sf_dir, ["ridge"], delta=True)


@query("fitted_leaderboard")
def fitted_leaderboard(spark, sf_dir):
    return metrics.leaderboard(fitted(spark, sf_dir, ["ridge", "random_forest"]))


@query("residual_bands")
def residual_bands(spark, sf_dir):
    preds = fitted(spark, sf_dir, ["random_forest"])
    return models.residual_bands(preds, date(2000, 6, 30))


@query("quantile_forest")
def quantile_forest(spark, sf_dir):
    panel = stored_panel(spark, sf_dir)
    return models.quantile_forest_folds(panel, yearly(panel), HORIZON)


@query("boosted_quantiles")
def boosted_quantiles(spark, sf_dir):
    panel = stored_panel(spark, sf_dir)
    return models.boosted_quantile_folds(panel, yearly(panel), HORIZON)


@query("out_of_bag_bands")
def out_of_bag_bands(spark, sf_dir):
    panel = stored_panel(spark, sf_dir)
    return models.out_of_bag_band_folds(panel, yearly(panel), HORIZON)


_NEXT = "CAST(CASE WHEN isodow(ds) = 5 THEN ds + 3 ELSE ds + 1 END AS DATE)"


@query("recursive_forecasts", "SELECT series_id, ds, pos, y FROM s1 UNION ALL SELECT series_id, ds, pos, y FROM s2 UNION ALL SELECT series_id, ds, pos, y FROM s3", *BUSINESS,
       "last5 AS (SELECT series_id, max(ds) AS d, max(pos) AS p, list(y ORDER BY pos) AS v FROM (SELECT *, max(pos) OVER (PARTITION BY series_id) AS m FROM biz) WHERE pos > m - 5 GROUP BY 1)",
       f"s1 AS (SELECT series_id, {_NEXT.replace('ds', 'd')} AS ds, p + 1 AS pos, round(list_sum(v) / 5) AS y, v FROM last5)",
       f"s2 AS (SELECT series_id, {_NEXT} AS ds, pos + 1 AS pos, round(list_sum(v[2:5] || [y]) / 5) AS y, v[2:5] || [y] AS v FROM s1)",
       f"s3 AS (SELECT series_id, {_NEXT} AS ds, pos + 1 AS pos, round(list_sum(v[2:5] || [y]) / 5) AS y FROM s2)")
def recursive_forecasts(spark, sf_dir):
    """Three steps ahead, each the rounded mean of the five values before it, forecasts among them."""
    panel = business_panel(spark, sf_dir).select("series_id", "ds", "pos", "y")

    def step(rows):
        place = F.row_number().over(Window.partitionBy("series_id").orderBy(F.col("pos").desc()))
        recent = rows.withColumn("__r", place).where("__r <= 5").groupBy("series_id").agg(F.max("ds").alias("d"), F.max("pos").alias("p"), F.round(F.sum("y") / 5).alias("y"))
        return recent.select("series_id", F.date_add("d", F.when(F.weekday("d") == 4, 3).otherwise(1)).alias("ds"), (F.col("p") + 1).alias("pos"), "y")

    out = models.recursive_forecast(step, panel, 3)
    return out.join(panel.groupBy("series_id").agg(F.max("pos").alias("__last")), "series_id").where("pos > __last").drop("__last")


@query("feature_importance")
def feature_importance(spark, sf_dir):
    return models.importances(business_panel(spark, sf_dir), TRAIN_END, HORIZON)


@query("signal_control")
def signal_control(spark, sf_dir):
    return models.signal_control(business_panel(spark, sf_dir), TRAIN_END, HORIZON)


@query("grouped_forecasts")
def grouped_forecasts(spark, sf_dir):
    return models.grouped_forecasts(business_panel(spark, sf_dir), HORIZON)


@query("grouped_forecast_rows", "SELECT series_id, model, origin_date, target_date, origin_value, y_true FROM prows, (VALUES ('arx'), ('ets'), ('naive_last'), ('seasonal_ar'), ('theta')) m(model) WHERE y_true IS NOT NULL AND target_date >= DATE '1999-01-01'", *FORECASTS)
def grouped_forecast_rows(spark, sf_dir):
    """What the statistical forecasters forecast: every origin of all yearly folds, without the forecasts themselves."""
    return models.grouped_forecasts(business_panel(spark, sf_dir), HORIZON).select("series_id", "model", "origin_date", "target_date", "origin_value", "y_true")


@query("fitted_forecast_rows", "SELECT series_id, CAST(year(target_date) AS INTEGER) AS fold_id, origin_date, target_date, origin_value, y_true FROM prows WHERE y_true IS NOT NULL AND target_date >= DATE '1999-01-01'", *FORECASTS)
def fitted_forecast_rows(spark, sf_dir):
    """What the fitted models forecast, by fold, without the forecasts themselves."""
    return fitted(spark, sf_dir, ["ridge"]).select("series_id", "fold_id", "origin_date", "target_date", "origin_value", "y_true")


@query(
    "scaler_statistics",
    """SELECT feature, round(avg(value), 3) AS mean, round(CASE WHEN stddev_pop(value) > 0 THEN stddev_pop(value) ELSE 1 END, 3) AS std FROM (UNPIVOT (SELECT lag(y, 1) OVER w AS lag_1, lag(y, 20) OVER w AS lag_20, y AS now, CAST(isodow(ds) - 1 AS DOUBLE) AS dow, CAST(month(ds) AS DOUBLE) AS month, lead(ds, 5) OVER w AS t FROM biz WINDOW w AS (PARTITION BY series_id ORDER BY pos))
  ON lag_1, lag_20, now, dow, month INTO NAME feature VALUE value) WHERE t <= DATE '1999-12-31' GROUP BY 1""",
    *BUSINESS,
)
def scaler_statistics(spark, sf_dir):
    out = models.scaler_statistics(business_panel(spark, sf_dir), TRAIN_END, HORIZON)
    return rounded(out.where(F.col("feature").isin("lag_1", "lag_20", "now", "dow", "month")), 3, "mean", "std")


@query("ablation")
def ablation(spark, sf_dir):
    panel = stored_panel(spark, sf_dir)
    return by_fold(panel, lambda *dates: runs.ablation(panel, *dates, HORIZON))


@query("group_ablation")
def group_ablation(spark, sf_dir):
    """Groups A to E, and two exogenous blocks: the other order priorities, and the urgent ones."""
    panel = stored_panel(spark, sf_dir)
    names = sorted(r["series_id"] for r in panel.select("series_id").distinct().collect())  # a row for each series of this panel
    return groups.ablation(panel, cal_fn.calendar(spark, 1995, 2001), yearly(panel), HORIZON, blocks={"cross": names, "urgent": names[:2]})


@query("exogenous_block", """SELECT series_id, ds, max(CASE WHEN place = 1 THEN l1 END) AS x1_lag1, max(CASE WHEN place = 1 THEN l5 END) AS x1_lag5, max(CASE WHEN place = 2 THEN l1 END) AS x2_lag1, max(CASE WHEN place = 2 THEN l5 END) AS x2_lag5
  FROM (SELECT b.series_id, b.ds, c.place, l.l1, l.l5 FROM biz b JOIN c ON c.series_id = b.series_id AND c.place <= 2 JOIN l ON l.series_id = c.x AND l.ds = b.ds) GROUP BY 1, 2""", *BUSINESS,
       "c AS (SELECT series_id, x, row_number() OVER (PARTITION BY series_id ORDER BY abs(r) DESC NULLS LAST, x) AS place FROM (SELECT a.series_id, b.series_id AS x, corr(a.y, b.y) AS r FROM biz a JOIN biz b ON a.ds = b.ds AND a.series_id <> b.series_id WHERE a.ds <= DATE '1999-12-31' GROUP BY 1, 2))",
       "l AS (SELECT series_id, ds, lag(y, 1) OVER w AS l1, lag(y, 5) OVER w AS l5 FROM biz WINDOW w AS (PARTITION BY series_id ORDER BY pos))")
def exogenous_block(spark, sf_dir):
    panel = stored_panel(spark, sf_dir)
    names = [r["series_id"] for r in panel.select("series_id").distinct().collect()]
    return groups.exogenous(panel, names, TRAIN_END, top=2)[0]


@query("daily_run")
def daily_run(spark, sf_dir):
    panel, since = stored_panel(spark, sf_dir), date(2001, 1, 1)
    current = [f for f in yearly(panel) if f[3] >= since]
    return runs.daily_run(panel, HORIZON, since.isoformat(), work_folder(spark), {"horizon": str(HORIZON)}, current)


@query("log_times", """SELECT event_type AS log, CAST(date_trunc('second', min(ts)) AS VARCHAR) AS started, CAST(date_trunc('second', max(ts)) AS VARCHAR) AS finished,
  CAST(epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts))) AS BIGINT) AS seconds FROM events GROUP BY 1""")  # fmt: skip
def log_times(spark, sf_dir):
    """Event rows as lines of a log; some lines have no time stamp."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    lines = rows.select("event_type", F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("] INFO user "), F.col("user_id")).alias("line"))
    lines = lines.unionByName(rows.where("event_id % 7 = 0").select("event_type", F.lit("  continued, no time").alias("line")))
    out = runs.log_times(lines, "event_type", "line")
    return out.select("log", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("started", "finished")], "seconds")
