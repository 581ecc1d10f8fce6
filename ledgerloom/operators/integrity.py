"""Checks of panels and forecasts: alignment, leakage, lagged copies, overfitting, preflight."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metrics import KEYS
from .panel import correlation


def alignment(preds: DataFrame, panel: DataFrame, examples: int = 10) -> DataFrame:
    """Per series and horizon: rows whose target isn't exactly ``horizon`` positions after its origin, by kind of fault."""
    at = panel.select("series_id", "ds", "pos")
    size = panel.groupBy("series_id").agg(F.max("pos").alias("last"))
    rows = preds.join(at.select("series_id", F.col("ds").alias("origin_date"), F.col("pos").alias("po")), ["series_id", "origin_date"], "left")
    rows = rows.join(at.select("series_id", F.col("ds").alias("target_date"), F.col("pos").alias("pt")), ["series_id", "target_date"], "left").join(size, "series_id", "left")
    due = F.col("po") + F.col("horizon")
    fault = F.when(F.col("po").isNull(), "origin_missing").when(due > F.col("last"), "out_of_bounds").when(F.col("pt").eqNullSafe(due), "ok").otherwise("misaligned")
    return rows.withColumn("fault", fault).groupBy("series_id", "horizon", "fault").agg(F.count("*").alias("n"), F.slice(F.sort_array(F.collect_set(F.when(F.col("fault") != "ok", F.col("target_date")))), 1, examples).alias("examples"))


def reach(horizon: int) -> int:
    """Shifts that are tried either way."""
    return max(horizon + 5, 10)


def _shifted(preds: DataFrame, most: int) -> DataFrame:
    """Each prediction with the actual ``shift`` places on, for shifts from ``-most`` to ``most``: one window, no self-join."""
    w = Window.partitionBy(*KEYS).orderBy("target_date")
    moved = F.array(*[F.struct(F.lit(k).alias("shift"), F.lead("y_true", k).over(w).alias("actual")) for k in range(-most, most + 1)])
    return preds.select(*KEYS, "y_pred", moved.alias("__moved")).select(*KEYS, "y_pred", F.explode("__moved").alias("m")).select(*KEYS, "y_pred", "m.*").where("actual IS NOT NULL AND y_pred IS NOT NULL")


def shift_errors(preds: DataFrame, most: int) -> DataFrame:
    """MAE of each model's predictions against actuals ``shift`` places on, for shifts from ``-most`` to ``most``."""
    return _shifted(preds, most).groupBy(*KEYS, "shift").agg(F.avg(F.abs(F.col("actual") - F.col("y_pred"))).alias("mae"))


def shift_diagnostic(preds: DataFrame, most: int) -> DataFrame:
    """The shift with the least MAE and what it says, relative to the horizon.

    Shift 0 wins ties, then the earliest. ``ok``: within a step of 0;
    ``persistence_like``: ``-h``; ``missing_lag_0``: ``-(h + 1)``;
    ``backward``: before that; ``forward``: after 0; any other is ``ok``. ``naive_equivalent``: the error lies within a tenth of
    that at shift ``-h``.
    """
    errors, h = shift_errors(preds, most), F.col("horizon")
    at = lambda k: F.max(F.when(F.col("shift") == k, F.col("mae")))
    best = errors.groupBy(*KEYS).agg(F.min_by("shift", F.struct("mae", F.col("shift") != 0, "shift")).alias("best_shift"), F.min("mae").alias("best_mae"), at(F.lit(0)).alias("mae_0"), at(-h).alias("mae_h"), at(-h - 1).alias("mae_h1"))
    s = F.col("best_shift")
    kind = F.when(F.abs(s) <= 1, "ok").when(s == -h, "persistence_like").when(s == -h - 1, "missing_lag_0").when(s < -h, "backward").when(s > 0, "forward").otherwise("ok")
    gain = F.when(F.col("mae_0") > 0, 100 * (F.col("mae_0") - F.col("best_mae")) / F.col("mae_0")).otherwise(0.0)
    close = F.abs(F.col("mae_0") - F.col("mae_h")) / F.greatest("mae_0", "mae_h", F.lit(1.0)) < 0.1
    return best.withColumns({"shift_class": kind, "improvement_pct": gain, "naive_equivalent": F.coalesce(close, F.lit(False))})


def lagged_copy(preds: DataFrame, most: int = 3, skip: str = "(?i)baseline|naive|persistence") -> DataFrame:
    """Models that repeat a recent actual.

    ``best_shift`` is the number of places by which the actual lies before the
    prediction's own that correlates best with it (the smallest of equal
    ones). A copy is one that correlates better by over 0.05 there than at 0
    **and** doesn't beat the actual of the day before (MAE below 0.99 of its
    own). Models named by ``skip`` copy by design, and those with fewer than
    ``most + 5`` values say nothing: neither gets a row.
    """
    rows = preds.where(~F.col("model").rlike(skip)).where("y_true IS NOT NULL AND y_pred IS NOT NULL")
    before = F.lag("y_true").over(Window.partitionBy(*KEYS).orderBy("target_date"))
    errors = rows.withColumn("b", before).groupBy(*KEYS).agg(F.count("*").alias("n"), F.avg(F.abs(F.col("y_true") - F.col("y_pred"))).alias("mae"), F.avg(F.abs(F.col("y_true") - F.col("b"))).alias("mae_lag_1"))
    corr = _shifted(rows, most).groupBy(*KEYS, (-F.col("shift")).alias("back")).agg(F.when(F.count("*") >= 3, correlation("y_pred", "actual")).alias("corr"))
    # Correlations are compared at six digits, so that equal ones tie.
    corr = corr.withColumn("r", F.round("corr", 6)).where("r IS NOT NULL")
    best = corr.groupBy(*KEYS).agg(F.max_by("back", F.struct("r", -F.col("back"))).alias("best_shift"), F.max("r").alias("corr_best"), F.max(F.when(F.col("back") == 0, F.col("r"))).alias("corr_0"))
    shifted = (F.col("best_shift") != 0) & (F.col("corr_best") - F.col("corr_0") > 0.05)
    out = best.join(errors.where(F.col("n") >= most + 5), KEYS)
    return out.select(*KEYS, "best_shift", "corr_best", "corr_0", "mae", "mae_lag_1", F.coalesce(shifted & (F.col("mae") >= 0.99 * F.col("mae_lag_1")), F.lit(False)).alias("is_copy"))


def feature_leakage(long_features: DataFrame, targets: DataFrame, limit: float = 0.99, least: int = 11) -> DataFrame:
    """Features that know the target: a name that tells of a step ahead, or a correlation with the value ahead beyond the limit over ``least`` pairs or more."""
    both = long_features.join(targets.select("series_id", "pos", "target"), ["series_id", "pos"]).where("value IS NOT NULL AND target IS NOT NULL")
    out = both.groupBy("series_id", "feature").agg(F.count("*").alias("n"), correlation("value", "target").alias("corr"))
    ahead = F.lower("feature").contains("shift(-") | F.lower("feature").contains("lag_-")
    return out.withColumns({"suspicious_name": ahead, "leaks": ahead | F.coalesce((F.abs("corr") > limit) & (F.col("n") >= least), F.lit(False))})


def temporal_leaks(preds: DataFrame) -> DataFrame:
    return preds.groupBy(*KEYS).agg(F.count_if(F.col("origin_date") >= F.col("target_date")).alias("n_leaks"))


def overfit_ratios(scores: DataFrame) -> DataFrame:
    """Worst validation/train MAE ratio of each model; infinite for a training error of 0. ``scores``: ``model, fold_id, train_mae, val_mae``."""
    ratio = F.when(F.col("train_mae") == 0, F.lit(float("inf"))).otherwise(F.col("val_mae") / F.col("train_mae"))
    return scores.groupBy("model").agg(F.max(ratio).alias("worst_ratio"))


def best_model(board: DataFrame, ratios: DataFrame, gate: float = 3.0) -> DataFrame:
    """Lowest MAE among models within the gate; among all if none is."""
    rows = board.join(F.broadcast(ratios), "model", "left").withColumn("out", F.coalesce((F.col("worst_ratio") > gate).cast("int"), F.lit(0)))
    return rows.groupBy("series_id", "horizon").agg(F.min_by("model", F.struct("out", "mae", "model")).alias("best"), F.min("out").cast("boolean").alias("fell_back"))


def fold_stability(preds: DataFrame, training: DataFrame | None = None) -> DataFrame:
    """Per series and model: folds, mean MAE, its coefficient of variation, slope, worst test/train ratio, risk. ``preds`` have ``fold_id``.

    :param training: ``series_id, model, fold_id, train_mae``, where training errors are known.

    A fold needs two rows. The variation (sample deviation over mean) needs two
    folds: above 0.5 it is high, above 0.3 medium. The slope is that of
    ``mae / mean`` over folds numbered from 0 to 1, and needs three: above 0.5
    high, above 0.25 medium. A ratio above 2 is high, one below 0.5 medium.
    Baselines are left out.
    """
    rows = preds.where(~F.col("model").rlike("(?i)baseline")).where("y_true IS NOT NULL AND y_pred IS NOT NULL")
    folds = rows.groupBy("series_id", "model", "fold_id").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("y_true") - F.col("y_pred"))).alias("mae")).where("n >= 2")
    known = folds.withColumn("train_mae", F.lit(None).cast("double")) if training is None else folds.join(training.select("series_id", "model", "fold_id", "train_mae"), ["series_id", "model", "fold_id"], "left")
    place = (F.row_number().over(Window.partitionBy("series_id", "model").orderBy("fold_id")) - 1).cast("double")
    known = known.withColumns({"k": place, "ratio": F.when(F.col("train_mae") > 0, F.col("mae") / F.col("train_mae"))})
    out = known.groupBy("series_id", "model").agg(
        F.count("*").alias("n_folds"), F.avg("mae").alias("mean_mae"), F.when(F.avg("mae") > 0, F.stddev_samp("mae") / F.avg("mae")).alias("cv"),
        F.when(F.count("*") >= 3, F.regr_slope("mae", "k") * (F.count("*") - 1) / F.greatest(F.avg("mae"), F.lit(1e-9))).alias("slope"), F.max("ratio").alias("worst_ratio"), F.min("ratio").alias("least_ratio"),
    )
    high = (F.col("cv") > 0.5) | (F.col("slope") > 0.5) | (F.col("worst_ratio") > 2)
    medium = (F.col("cv") > 0.3) | (F.col("slope") > 0.25) | (F.col("least_ratio") < 0.5)
    return out.withColumn("risk", F.when(high, "high").when(medium, "medium").otherwise("low")).drop("least_ratio")


def preflight(rows: DataFrame, date: str, value: str, horizon: int, cadence: str = "daily", by: str = "series_id", gap_days: int = 5, z_limit: float = 4.0) -> DataFrame:
    """Per series: what prevents a run (``blockers``), what is to be known (``warnings``), and the figures behind it.

    :param rows: as they come; dates and values may be text.

    Blockers end the checks that follow them: no date column, no row with a
    date, no value column, over half of the values not numbers. Then: fewer
    than ``3 * horizon + 30`` values, a constant series. Warnings: dates that
    don't parse, over 5 % without a value, repeated dates, gaps of over
    ``gap_days`` (daily data), values whose z-score over the last 60 (20 at
    least) is beyond ``z_limit`` (series of over 60 values).
    """
    if date not in rows.columns:
        return rows.groupBy(by).agg(F.count("*").alias("n_rows")).withColumns({"blockers": F.lit("no_date_column"), "warnings": F.lit("")})
    day = F.to_date(F.try_to_timestamp(F.col(date).cast("string")))
    raw = F.col(value) if value in rows.columns else F.lit(None)
    own = rows.select(F.col(by).alias("series_id"), day.alias("ds"), raw.cast("string").alias("raw"), F.expr("try_cast(raw AS double)").alias("v"))
    own = own.withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    order = Window.partitionBy("series_id").orderBy("ds")
    dated = F.col("v").isNotNull() & F.col("ds").isNotNull()
    recent = Window.partitionBy("series_id", dated).orderBy("ds").rowsBetween(-59, 0)
    sd = F.stddev_samp("v").over(recent)
    own = own.withColumns({"gap": F.datediff("ds", F.lag("ds").over(order)), "z": F.when(dated & (F.count("v").over(recent) >= 20) & (sd > 0), F.abs((F.col("v") - F.avg("v").over(recent)) / sd))})
    out = own.groupBy("series_id").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("ds").isNull()).alias("n_undated"), F.min("ds").alias("first_day"), F.max("ds").alias("last_day"), F.count("v").alias("n_values"),
        F.count_if(F.col("v").isNull() & F.col("raw").isNotNull()).alias("n_text"), F.count_if(F.col("v").isNull()).alias("n_missing"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("least"), F.max("v").alias("most"),
        F.count_if(F.col("gap") == 0).alias("n_repeated"), F.count_if(F.col("gap") > gap_days).alias("n_gaps"), F.max("gap").alias("longest_gap"), F.count_if(F.col("z") > z_limit).alias("n_outliers"), F.mode("gap", True).alias("step_days"),
    )
    some = F.col("n_rows") > F.col("n_undated")
    there = F.lit(value in rows.columns)
    open_ = some & there & (F.col("n_text") <= 0.5 * F.col("n_rows"))
    blockers = [(~some, "no_dates"), (some & ~there, "no_value_column"), (some & there & ~open_, "not_numeric"), (open_ & (F.col("n_values") < 3 * horizon + 30), "too_short"), (open_ & (F.col("n_values") > 1) & (F.col("std") == 0), "constant")]
    warnings = [(some & (F.col("n_undated") > 0), "undated_rows"), (open_ & (100 * F.col("n_missing") > 5 * F.col("n_rows")), "missing_values"), (open_ & (F.col("n_repeated") > 0), "repeated_dates")]
    warnings += [(open_ & (F.col("n_gaps") > 0) & F.lit(cadence == "daily"), "gaps"), (open_ & (F.col("n_values") > 60) & (F.col("n_outliers") > 0), "outliers")]
    joined = lambda pairs: F.array_join(F.array_compact(F.array(*[F.when(c, n) for c, n in pairs])), ",")
    return out.withColumns({"blockers": joined(blockers), "warnings": joined(warnings)})


def freshness(panel: DataFrame, run_date: str, stale_after: int = 7) -> DataFrame:
    days = F.datediff(F.lit(run_date).cast("date"), F.max("ds"))
    return panel.groupBy("series_id").agg(F.max("ds").alias("last_day"), days.alias("age_days"), (days > stale_after).alias("is_stale"))
