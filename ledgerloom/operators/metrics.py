"""Scores of forecasts in the long form ``series_id, model, horizon, origin_date, target_date, origin_value, y_true, y_pred[, y_lo, y_hi]``.

Each is one grouped aggregate, so partial sums are made before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .panel import classify_kind

EPS = 1e-9
KEYS = ["series_id", "horizon", "model"]


def _error() -> Column:
    return F.col("y_true") - F.col("y_pred")


def point() -> list[Column]:
    """n, MAE, RMSE and R2 (null without variance)."""
    e, n = _error(), F.count(F.col("y_true") - F.col("y_pred"))
    spread = F.var_pop("y_true") * n
    return [n.alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.when(spread > 0, 1 - F.sum(e * e) / spread).alias("r2")]


def is_level(preds: DataFrame) -> Column:
    """Whether a forecast is of a level: by ``kind``, which travels with forecasts, else by the series' name."""
    kind = F.col("kind") if "kind" in preds.columns else classify_kind(F.col("series_id"))
    return kind == "level"


def percentage(level: Column | None = None) -> list[Column]:
    """MAPE and sMAPE with a guard against 0; null for levels, whose zero is a convention."""
    e = F.abs(_error())
    parts = [F.avg(e / F.greatest(F.abs("y_true"), F.lit(EPS))), F.avg(2 * e / (F.abs("y_true") + F.abs("y_pred") + EPS))]
    if level is not None:
        parts = [F.when(~F.coalesce(F.bool_or(level), F.lit(False)), p) for p in parts]
    return [(100 * p).alias(n) for p, n in zip(parts, ("mape", "smape"))]


def intervals() -> list[Column]:
    """Share of values within their bounds, and the mean width, where both bounds are there."""
    there = F.col("y_lo").isNotNull() & F.col("y_hi").isNotNull() & F.col("y_true").isNotNull()
    inside = F.when(there, F.col("y_true").between(F.col("y_lo"), F.col("y_hi")).cast("double"))
    return [F.avg(inside).alias("coverage"), F.avg(F.when(there, F.col("y_hi") - F.col("y_lo"))).alias("width")]


def persistence() -> list[Column]:
    e = F.col("y_true") - F.col("origin_value")
    return [F.avg(F.abs(e)).alias("persistence_mae"), F.sqrt(F.avg(e * e)).alias("persistence_rmse")]


def skill(model: str | Column, baseline: str | Column) -> Column:
    """Per cent by which the error is below the baseline's; null where that isn't above 0."""
    b, m = (F.col(x) if isinstance(x, str) else x for x in (baseline, model))
    return F.when(b > 0, 100 * (b - m) / b)


def monthly_tolerance(preds: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Share of months whose sum is forecast within the tolerance; of levels, whose last value is."""
    level = F.bool_or(is_level(preds))
    of = lambda c: F.when(level, F.max_by(c, "target_date")).otherwise(F.sum(c))
    months = preds.groupBy(*KEYS, F.trunc("target_date", "month").alias("month")).agg(of("y_true").alias("t"), of("y_pred").alias("p"))
    near = F.abs(F.col("p") - F.col("t")) / F.greatest(F.abs("t"), F.lit(EPS)) <= tolerance
    return months.groupBy(*KEYS).agg(F.avg(near.cast("double")).alias("monthly_tol10"))


def block(preds: DataFrame) -> DataFrame:
    """All scores of each series, horizon and model, with the skill over persistence."""
    out = preds.groupBy(*KEYS).agg(*point(), *percentage(is_level(preds)), *intervals(), *persistence())
    return out.withColumn("skill", skill("mae", "persistence_mae")).join(monthly_tolerance(preds), KEYS)


def seasonal_naive(preds: DataFrame, season: int) -> DataFrame:
    """MAE of the value ``season`` scored target dates before each, by series and horizon; null and flagged where season and horizon are equal (that is persistence)."""
    once = preds.where("y_true IS NOT NULL").groupBy("series_id", "horizon", "target_date").agg(F.max("y_true").alias("y"))  # models share their targets
    before = F.lag("y", season).over(Window.partitionBy("series_id", "horizon").orderBy("target_date"))
    out = once.withColumn("__b", before).groupBy("series_id", "horizon").agg(F.avg(F.abs(F.col("y") - F.col("__b"))).alias("mae"), F.count("__b").alias("n"))
    same = F.col("horizon") == season
    return out.select("series_id", "horizon", F.when(~same, F.col("mae")).alias("seasonal_naive_mae"), F.when(~same, F.col("n")).alias("n"), same.alias("same_as_persistence"))


def mase(preds: DataFrame, panel: DataFrame, train_end: str, season: int) -> DataFrame:
    """MAE over the seasonal-naive MAE of the training rows alone."""
    before = F.lag("y", season).over(Window.partitionBy("series_id").orderBy("pos"))
    scale = panel.where(F.col("ds") <= F.lit(train_end).cast("date")).withColumn("__b", before).groupBy("series_id").agg(F.avg(F.abs(F.col("y") - F.col("__b"))).alias("scale"))
    own = preds.groupBy(*KEYS).agg(F.avg(F.abs(_error())).alias("mae"))
    return own.join(scale, "series_id").withColumn("mase", F.when(F.col("scale") > 0, F.col("mae") / F.col("scale")))


def pinball(y: str, q_hat: str, q: float) -> Column:
    e = F.col(y) - F.col(q_hat)
    return F.avg(F.greatest(q * e, (q - 1) * e))


def leaderboard(preds: DataFrame) -> DataFrame:
    """Models of each series and horizon by MAE (ties by name); persistence as rank 0 with its own error."""
    own = preds.groupBy(*KEYS).agg(F.avg(F.abs(_error())).alias("mae"), F.avg(F.abs(F.col("y_true") - F.col("origin_value"))).alias("b"))
    place = F.row_number().over(Window.partitionBy("series_id", "horizon").orderBy("mae", "model"))
    ranked = own.select(*KEYS, "mae", skill("mae", "b").alias("skill"), place.alias("rank"))
    base = own.groupBy("series_id", "horizon").agg(F.min_by("b", "model").alias("mae")).select("series_id", "horizon", F.lit("persistence").alias("model"), "mae", F.lit(0.0).alias("skill"), F.lit(0).alias("rank"))
    return ranked.unionByName(base)


def tercile_coverage(preds: DataFrame) -> DataFrame:
    """Coverage by magnitude: thirds of each model's targets by absolute value."""
    third = F.ntile(3).over(Window.partitionBy(*KEYS).orderBy(F.abs("y_true"), "target_date"))
    return preds.withColumn("tercile", third).groupBy(*KEYS, "tercile").agg(F.count("*").alias("n"), *intervals())


def errors_by_month(preds: DataFrame) -> DataFrame:
    return preds.groupBy(*KEYS, F.trunc("target_date", "month").alias("month")).agg(F.count("*").alias("n"), F.avg(F.abs(_error())).alias("mae"), F.avg(_error()).alias("bias"))


def residual_histogram(preds: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    return preds.groupBy("model", F.width_bucket(_error(), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def rolling_error(preds: DataFrame, window: int = 20, least: int = 5) -> DataFrame:
    frame = Window.partitionBy(*KEYS).orderBy("target_date").rowsBetween(-(window - 1), 0)
    e = F.abs(_error())
    return preds.withColumn("rolling_mae", F.when(F.count(e).over(frame) >= least, F.avg(e).over(frame)))


def against_baseline(preds: DataFrame, baseline: DataFrame) -> DataFrame:
    """Skill over an operational baseline ``series_id, target_date, baseline``, on the dates it covers."""
    both = preds.join(baseline, ["series_id", "target_date"], "left").where("baseline IS NOT NULL")
    out = both.groupBy(*KEYS).agg(F.count("*").alias("n"), F.avg(F.abs(_error())).alias("mae"), F.avg(F.abs(F.col("y_true") - F.col("baseline"))).alias("ops_mae"))
    return out.withColumn("skill_vs_ops", skill("mae", "ops_mae"))


def conformal_radius(preds: DataFrame, from_date: str, q: float = 0.9) -> DataFrame:
    """Quantile of absolute residuals of a held tail."""
    return preds.where(F.col("target_date") >= F.lit(from_date).cast("date")).groupBy(*KEYS).agg(F.percentile(F.abs(_error()), F.lit(q)).alias("radius"))


def heatmap(metrics: DataFrame, value: str, horizons: list[int]) -> DataFrame:
    return metrics.groupBy("model").pivot("horizon", horizons).agg(F.avg(value))
