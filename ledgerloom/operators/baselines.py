"""Forecasters and operational baselines that window functions and aggregates express."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .panel import by_series

PREDICTION = ["series_id", "model", "horizon", "origin_date", "target_date", "origin_value", "y_true", "y_pred", "y_lo", "y_hi"]


def window_forecasts(panel: DataFrame, horizon: int, window: int = 20, z: float = 1.96) -> DataFrame:
    """Direct forecasts ``horizon`` positions on from every origin, by persistence, weekday mean and moving average.

    One pass: all windows share the partition and order, and models are one
    array that is exploded. Bounds are ``z`` population deviations of the
    moving window, persistence has none. A weekday mean takes the origin's
    past rows of the target's weekday.
    """
    frame = by_series().rowsBetween(-(window - 1), 0)
    rows = panel.withColumns({"target_date": F.lead("ds", horizon).over(by_series()), "y_true": F.lead("y", horizon).over(by_series()), "ma": F.avg("y").over(frame), "sd": F.stddev_pop("y").over(frame)})
    if horizon % 5 == 0:  # the target's weekday is the origin's
        rows = rows.withColumn("dow", F.weekday("ds")).withColumn("wm", F.avg("y").over(by_series("pos", "dow").rowsBetween(Window.unboundedPreceding, 0)))
    else:
        # Running sums by weekday at every origin; the target's weekday picks one.
        past = by_series().rowsBetween(Window.unboundedPreceding, 0)
        means = F.array(*[F.avg(F.when(F.weekday("ds") == d, F.col("y"))).over(past) for d in range(5)])
        rows = rows.withColumn("wm", F.when(F.weekday("target_date") < 5, F.get(means, F.weekday("target_date"))))
    models = F.array(
        F.struct(F.lit("naive_last").alias("model"), F.col("y").alias("y_pred"), F.lit(None).cast("double").alias("half")),
        F.struct(F.lit("weekday_mean").alias("model"), F.col("wm").alias("y_pred"), (z * F.col("sd")).alias("half")),
        F.struct(F.lit(f"moving_average_{window}").alias("model"), F.col("ma").alias("y_pred"), (z * F.col("sd")).alias("half")),
    )
    rows = rows.where("y_true IS NOT NULL").withColumn("m", F.explode(models))
    return rows.select("series_id", "m.model", F.lit(horizon).alias("horizon"), F.col("ds").alias("origin_date"), "target_date", F.col("y").alias("origin_value"), "y_true", "m.y_pred", (F.col("m.y_pred") - F.col("m.half")).alias("y_lo"), (F.col("m.y_pred") + F.col("m.half")).alias("y_hi"))


def weekday_profile(panel: DataFrame) -> DataFrame:
    return panel.groupBy("series_id", F.weekday("ds").alias("dow")).agg(F.avg("y").alias("mean"), F.count("*").alias("n"))


def one_step_backtest(panel: DataFrame, window: int = 5, last: int = 30) -> DataFrame:
    """Absolute error of the naive and the moving-average forecast over each series' last points."""
    rows = panel.withColumns({"naive": F.lag("y").over(by_series()), "ma": F.avg("y").over(by_series().rowsBetween(-window, -1)), "r": F.row_number().over(Window.partitionBy("series_id").orderBy(F.col("pos").desc()))})
    return rows.where(F.col("r") <= last).groupBy("series_id").agg(F.avg(F.abs(F.col("y") - F.col("naive"))).alias("naive_mae"), F.avg(F.abs(F.col("y") - F.col("ma"))).alias("ma_mae"))


def months(panel: DataFrame) -> DataFrame:
    """``series_id, year, month, total``."""
    return panel.groupBy("series_id", F.year("ds").alias("year"), F.month("ds").alias("month")).agg(F.sum("y").alias("total"))


def monthly_baseline(panel: DataFrame, back: int = 3) -> DataFrame:
    """``series_id, year, month, total, baseline, n_years``: mean of the ``back`` prior years' totals times the month's mean share of them.

    All the prior years must be full (have twelve months); where one isn't, the
    baseline is the last one known before, if there is any. Shares of years
    whose total isn't above 0 don't count. Months without a row have a total of 0.
    """
    found = months(panel)
    at = F.make_date("year", "month", F.lit(1))
    span = found.groupBy("series_id").agg(F.min(at).alias("a"), F.max(at).alias("b"))
    every = span.select("series_id", F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 MONTH"))).alias("m")).select("series_id", F.year("m").alias("year"), F.month("m").alias("month"))
    m = every.join(found, ["series_id", "year", "month"], "left").withColumn("total", F.coalesce("total", F.lit(0.0)))
    full = m.groupBy("series_id", "year").agg(F.sum("total").alias("year_total"), F.count("*").alias("n")).where("n = 12")
    share = F.when(F.col("year_total") > 0, F.col("total") / F.col("year_total"))
    served = m.join(full, ["series_id", "year"]).select("series_id", "month", "year_total", share.alias("share"), F.explode(F.sequence(F.col("year") + 1, F.col("year") + back)).alias("year"))
    base = served.groupBy("series_id", "year", "month").agg(F.count("*").alias("n_years"), F.when(F.count("*") == back, F.avg("year_total") * F.avg("share")).alias("own"))
    known = F.last("own", ignorenulls=True).over(Window.partitionBy("series_id").orderBy("year", "month").rowsBetween(Window.unboundedPreceding, 0))
    return m.join(base, ["series_id", "year", "month"], "left").withColumn("baseline", known).select("series_id", "year", "month", "total", "baseline", "n_years")


def same_month_mean(panel: DataFrame, back: int = 3) -> DataFrame:
    """Fallback: mean of the same month in up to ``back`` earlier years."""
    w = Window.partitionBy("series_id", "month").orderBy("year").rowsBetween(-back, -1)
    return months(panel).withColumn("fallback", F.avg("total").over(w))


def spread_month(panel: DataFrame, monthly: DataFrame, back: int = 3, method: str = "profile") -> DataFrame:
    """A month's baseline over its weekdays; evenly where prior years tell nothing. ``panel`` lies on weekdays.

    ``profile``: by the mean share that the same day of the month took in prior
    years, renormalised over the month's days. ``average``: by the mean value
    that the same date had in prior years; a date that had none gets none.
    """
    if method not in ("profile", "average"):
        raise ValueError(f"no method {method!r}")
    rows = panel.select("series_id", "ds", "y", F.year("ds").alias("year"), F.month("ds").alias("month"), F.dayofmonth("ds").alias("dom"))
    month = Window.partitionBy("series_id", "year", "month")
    if method == "average":
        asked = rows.select("series_id", "ds", F.explode(F.array(*[F.add_months("ds", -12 * k) for k in range(1, back + 1)])).alias("old"))
        values = panel.select(F.col("series_id").alias("__s"), F.col("ds").alias("old"), F.col("y").alias("__v"))
        weights = asked.join(values, (F.col("series_id") == F.col("__s")) & (asked["old"] == values["old"])).groupBy("series_id", "ds").agg(F.avg("__v").alias("weight"))
        out, weight = rows.join(weights, ["series_id", "ds"], "left"), F.col("weight")
        usable = F.sum("weight").over(month) != 0
    else:
        total = F.sum("y").over(month)
        old = rows.withColumn("share", F.when(total != 0, F.col("y") / total)).select("series_id", "month", "dom", "share", F.explode(F.sequence(F.col("year") + 1, F.col("year") + back)).alias("year"))
        profile = old.groupBy("series_id", "year", "month", "dom").agg(F.avg("share").alias("share"))
        out, weight = rows.join(profile, ["series_id", "year", "month", "dom"], "left"), F.coalesce("share", F.lit(0.0))
        usable = F.sum(weight).over(month) > 0
    part = F.when(F.coalesce(usable, F.lit(False)), weight / F.sum(weight).over(month)).otherwise(1 / F.count("*").over(month))
    out = out.withColumn("part", part).join(monthly.select("series_id", "year", "month", "baseline"), ["series_id", "year", "month"], "left")
    return out.select("series_id", "ds", "y", (F.col("baseline") * F.col("part")).alias("baseline"))


def history_before(panel: DataFrame, preds: DataFrame, days: int) -> DataFrame:
    """Actuals of the days before each series' first forecast."""
    first = preds.groupBy("series_id").agg(F.min("target_date").alias("first"))
    return panel.join(first, "series_id").where((F.col("ds") < F.col("first")) & (F.col("ds") >= F.date_sub("first", days))).select("series_id", "ds", "y")


def kpis(panel: DataFrame, mean_rows: int = 30, std_rows: int = 90) -> DataFrame:
    """Last value, mean of the last rows, sample deviation of the last rows."""
    r = F.row_number().over(Window.partitionBy("series_id").orderBy(F.col("ds").desc()))
    rows = panel.withColumn("r", r)
    return rows.groupBy("series_id").agg(F.max_by("y", "ds").alias("last_value"), F.avg(F.when(F.col("r") <= mean_rows, F.col("y"))).alias("mean_30"), F.stddev_samp(F.when(F.col("r") <= std_rows, F.col("y"))).alias("std_90"))
