"""Ensembles, scorecards and gates over forecasts and their scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import integrity
from .metrics import KEYS, intervals, leaderboard, monthly_tolerance, point, skill

AT = ["series_id", "horizon", "origin_date", "target_date", "origin_value", "y_true"]


def model_errors(preds: DataFrame) -> DataFrame:
    return preds.groupBy(*KEYS).agg(F.avg(F.abs(F.col("y_true") - F.col("y_pred"))).alias("mae"))


def ensembles(preds: DataFrame, top: int = 3) -> DataFrame:
    """Median, mean of the best ``top`` models and inverse-error weighted mean, long, with bounds averaged over members that have them.

    Errors are those of each series and horizon, so scales don't mix.
    """
    errors = model_errors(preds)
    place = F.row_number().over(Window.partitionBy("series_id", "horizon").orderBy("mae", "model"))
    ranked = errors.withColumn("place", place)
    rows = preds.join(ranked, KEYS)
    w = 1 / F.greatest("mae", F.lit(1e-9))
    best = F.col("place") <= top
    out = rows.groupBy(*AT).agg(
        F.median("y_pred").alias("p_median"), F.avg(F.when(best, F.col("y_pred"))).alias("p_top"), (F.sum(w * F.col("y_pred")) / F.sum(w)).alias("p_weighted"), F.avg("y_lo").alias("y_lo"), F.avg("y_hi").alias("y_hi")
    )
    parts = F.array(*[F.struct(F.lit(f"ensemble_{n}").alias("model"), F.col(f"p_{n}").alias("y_pred")) for n in ("median", "top", "weighted")])
    return out.withColumn("m", F.explode(parts)).select("series_id", "m.model", "horizon", "origin_date", "target_date", "origin_value", "y_true", "m.y_pred", "y_lo", "y_hi")


def recommend(preds: DataFrame, shifts: DataFrame | None = None, folds: int = 1, gate: float = 5.0) -> DataFrame:
    """Best model of each series and horizon, its scorecard, a letter, risk flags, tips and next steps, as codes.

    :param shifts: ``integrity.shift_diagnostic`` of the same forecasts; a best shift other than 0 is a risk where the gate fails.
    :param folds: folds of the run that made the forecasts.

    Best is the lowest MAE (ties by name) among models that aren't baselines,
    among all if there is no other. The letter goes by sMAPE and R2, by R2
    alone never, as sMAPE is always there; N/A without R2. Skill over
    persistence below ``gate`` makes it F, whatever it was; tips go by the
    letter before that.
    """
    rows = preds.where("y_true IS NOT NULL AND y_pred IS NOT NULL")
    e, base = F.abs(F.col("y_true") - F.col("y_pred")), F.col("model").rlike("(?i)baseline|persistence")
    own = rows.groupBy(*KEYS).agg(
        *point(), F.avg(e / F.greatest(F.abs("y_true"), F.lit(1e-9))).alias("mape"), F.avg(2 * e / (F.abs("y_true") + F.abs("y_pred") + 1e-9)).alias("smape"), *intervals(), F.avg(F.abs(F.col("y_true") - F.col("origin_value"))).alias("persistence_mae")
    )
    first = F.row_number().over(Window.partitionBy("series_id", "horizon").orderBy(base, "mae", "model"))
    out = own.withColumn("place", first).where("place = 1").drop("place").join(monthly_tolerance(rows), KEYS).withColumn("skill", skill("mae", "persistence_mae"))
    if shifts is None:
        out = out.withColumn("best_shift", F.lit(0))
    else:
        out = out.join(shifts.select(*KEYS, "best_shift"), KEYS, "left").withColumn("best_shift", F.coalesce("best_shift", F.lit(0)))
    tiers = [("A", 0.05, 0.95), ("B", 0.10, 0.85), ("C", 0.20, 0.70), ("D", 0.35, 0.50)]  # fixed values: sMAPE below, R2 above
    letter = F.when(F.col("r2").isNull(), "N/A")
    for name, error, fit in tiers:
        letter = letter.when((F.col("smape") < error) & (F.col("r2") > fit), name)
    out = out.withColumns({"letter": letter.otherwise("F"), "gate_failed": F.coalesce(F.col("skill") < gate, F.lit(False))})
    failed, low = F.col("gate_failed"), F.col("letter").isin("D", "F")
    joined = lambda pairs: F.array_join(F.array_compact(F.array(*[F.when(c, n) for c, n in pairs])), ",")
    flags = [(failed & (F.col("skill") < 0), "worse_than_persistence"), (failed & (F.col("skill") >= 0), "below_gate"), (failed & (F.col("best_shift") != 0), "shifted"), (F.col("r2") < 0, "negative_r2"), (F.col("coverage") < 0.8, "narrow_intervals"), (F.col("monthly_tol10") < 0.5, "poor_months")]
    tips = [(low, "low_accuracy"), (F.col("letter") == "C", "room_to_improve"), (F.col("coverage") > 0.98, "wide_intervals"), (F.col("monthly_tol10") >= 0.8, "good_months"), (F.col("horizon") >= 10, "long_horizon")]
    good = F.col("letter").isin("A", "B")
    steps = [(F.lit(folds <= 1), "more_folds"), (F.lit(folds > 1) & good, "ensemble_of_best"), (F.lit(folds > 1) & ~good, "compare_models")]
    return out.select("series_id", "horizon", F.col("model").alias("best"), "n", "mae", "rmse", "mape", "smape", "r2", "monthly_tol10", "coverage", "width", "skill", F.when(failed, "F").otherwise(F.col("letter")).alias("grade"), "gate_failed", joined(flags).alias("flags"), joined(tips).alias("tips"), joined(steps).alias("next_steps"))


def podium(preds: DataFrame, places: int = 3) -> DataFrame:
    """First places of each series and horizon, and per cent by which each beats the next."""
    w = Window.partitionBy("series_id", "horizon").orderBy("mae", "model")
    rows = model_errors(preds).withColumns({"place": F.row_number().over(w), "next": F.lead("mae").over(w)})
    return rows.where(F.col("place") <= places).select(*KEYS, "mae", "place", F.when(F.col("next") > 0, 100 * (F.col("next") - F.col("mae")) / F.col("next")).alias("better_pct"))


def interval_gate(scores: DataFrame, least_skill: float = 5.0, low: float = 0.7, high: float = 0.9) -> DataFrame:
    """Models that pass on skill and coverage; the best is the lowest MAE among those that pass, else among all."""
    ok = F.coalesce((F.col("skill") >= least_skill) & F.col("coverage").between(low, high), F.lit(False))
    rows = scores.withColumn("passed", ok)
    return rows.groupBy("series_id", "horizon").agg(F.count_if("passed").alias("n_passed"), F.min_by("model", F.struct(~F.col("passed"), F.col("mae"), F.col("model"))).alias("best"))


def quality_gate(scores: DataFrame, least_skill: float = 5.0) -> DataFrame:
    status = F.when(F.coalesce("skill", F.lit(-1.0)) >= least_skill, "OK").otherwise("FAILED_QUALITY")
    return scores.select(*KEYS, "skill", status.alias("status"))


def model_checks(preds: DataFrame, most: int) -> DataFrame:
    """``series_id, horizon, model, leaks, shifted``: forecasts made at or after their target, and those that repeat the series (by shift, by nearness to the naive error, or as a lagged copy)."""
    shift = integrity.shift_diagnostic(preds, most).select(*KEYS, ((F.col("shift_class") != "ok") | F.col("naive_equivalent")).alias("__shift"))
    copies = integrity.lagged_copy(preds).select(*KEYS, "is_copy")
    out = integrity.temporal_leaks(preds).join(shift, KEYS, "left").join(copies, KEYS, "left")
    return out.select(*KEYS, (F.col("n_leaks") > 0).alias("leaks"), (F.coalesce("__shift", F.lit(False)) | F.coalesce("is_copy", F.lit(False))).alias("shifted"))


def family_verdicts(scores: DataFrame, families: dict[str, str], checks: DataFrame | None = None, quantile: tuple[str, ...] = ("quantile",), trained: tuple[str, ...] = ("fitted", "quantile")) -> DataFrame:
    """``series_id, horizon, family, n, best, best_skill, coverage, reasons, verdict``: a verdict where errors have one scale.

    :param checks: ``model_checks`` of the forecasts, with ``has_signal`` where the control was run.

    Best is the lowest MAE of models that aren't baselines. A family fails for
    a skill of its best below 5 (quantile families: a coverage outside 0.7 to
    0.9 too), a leak, forecasts that repeat the series, or, if it learns from
    features, a target that shuffles as well as it is. Without checks nothing
    has been verified, which must not look like a pass.
    """
    family = F.coalesce(F.create_map(*[F.lit(x) for kv in families.items() for x in kv])[F.col("model")], F.lit("other"))
    rows = scores.withColumn("family", family)
    if checks is not None:
        rows = rows.join(checks, KEYS, "left")
    for name in ("leaks", "shifted", "has_signal"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("boolean"))
    order = F.struct(F.col("model").rlike("(?i)baseline"), "mae", "model")
    best = lambda c: F.min_by(c, order)
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    own = rows.groupBy("series_id", "horizon", "family").agg(
        F.count("*").alias("n"), best("model").alias("best"), best("skill").alias("best_skill"), best("coverage").alias("coverage"), some("leaks").alias("leaks"), some("shifted").alias("shifted"), F.coalesce(~F.bool_or("has_signal"), F.lit(False)).alias("silent")
    )
    covered = F.coalesce(F.col("coverage").between(0.7, 0.9), F.lit(False))
    failed = F.coalesce(F.col("best_skill") < 5, F.lit(True)) | (F.col("family").isin(*quantile) & ~covered)
    reasons = F.array_compact(F.array(F.when(failed, "failed_quality"), F.when(F.col("leaks"), "leakage"), F.when(F.col("silent") & F.col("family").isin(*trained), "no_signal"), F.when(F.col("shifted"), "persistence_like")))
    verdict = F.when(F.col("reasons") != "", "fail").otherwise("pass" if checks is not None else "unverified")
    return own.withColumn("reasons", F.array_join(reasons, ",")).withColumn("verdict", verdict).drop("leaks", "shifted", "silent")


#: Reasons against a family, in the order in which they are given.
REASONS = ("failed_quality", "leakage", "no_signal", "persistence_like")


def family_summary(scores: DataFrame, families: dict[str, str], checks: DataFrame | None = None, **more) -> DataFrame:
    """``family, n, n_passed, best, best_skill, coverage, reasons, verdict``: how many series and horizons of a family pass (``family_verdicts``).

    ``best`` is the model that is best most often (ties by name), ``best_skill``
    the median skill of the best ones, ``coverage`` their mean, ``reasons`` how
    often each was given. The verdict is ``pass`` where all pass, ``partial``
    where some do, ``fail`` where none does, ``unverified`` without checks and reasons.
    """
    rows = family_verdicts(scores, families, checks, **more)
    given = [F.count_if(F.array_contains(F.split("reasons", ","), r)) for r in REASONS]
    out = rows.groupBy("family").agg(
        F.count("*").alias("n"), F.count_if(F.col("verdict") == "pass").alias("n_passed"), F.count_if(F.col("verdict") == "fail").alias("__failed"), F.mode("best", True).alias("best"), F.median("best_skill").alias("best_skill"), F.avg("coverage").alias("coverage"),
        F.array_join(F.array_compact(F.array(*[F.when(g > 0, F.concat(F.lit(f"{r}:"), g.cast("string"))) for r, g in zip(REASONS, given)])), ",").alias("reasons"),
    )
    verdict = F.when(F.col("__failed") == F.col("n"), "fail").when(F.col("n_passed") == F.col("n"), "pass").when((F.col("n_passed") > 0) | (F.col("__failed") > 0), "partial").otherwise("unverified")
    return out.withColumn("verdict", verdict).drop("__failed")


def best_by_run(preds: DataFrame) -> DataFrame:
    board = leaderboard(preds).where("rank > 0")
    return board.groupBy("series_id", "horizon").agg(F.min_by("model", F.struct("mae", "model")).alias("best"), F.min("mae").alias("mae"))


__all__ = ["best_by_run", "ensembles", "family_summary", "family_verdicts", "interval_gate", "model_checks", "model_errors", "podium", "quality_gate", "recommend", "skill"]
