"""Properties of panels and checks: causality, truncation, positive and negative controls."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import calendar as cal
from ledgerloom.operators import clean, ensemble, features, folds, integrity, metrics, models, panel as pn, rolling, runs
from ledgerloom.sources import ledger, runlog
from ledgerloom.streaming import rollup


def weekdays(n, start=date(2020, 1, 6)):
    out, d = [], start
    while len(out) < n:
        if d.weekday() < 5:
            out.append(d)
        d += timedelta(days=1)
    return out


@pytest.fixture(scope="module")
def series(spark):
    rows = [("a", d, i, float((i * 37) % 101)) for i, d in enumerate(weekdays(200))]
    return spark.createDataFrame(rows, "series_id string, ds date, pos int, y double")


def test_easter(spark):
    found = {r["year"]: r["e"] for r in cal.years(spark, 2023, 2025).select("year", cal.orthodox_easter(F.col("year")).alias("e")).collect()}
    assert found == {2023: date(2023, 4, 16), 2024: date(2024, 5, 5), 2025: date(2025, 4, 20)}


def test_deadlines_move_forward_only(spark):
    due = cal.deadlines(cal.calendar(spark, 2023, 2024))
    assert due.where("ds < nominal").count() == 0
    assert due.where("ds > nominal").count() > 0


def test_calendar_does_not_depend_on_the_end(spark):
    a = cal.period_features(cal.calendar(spark, 2022, 2024), "2022-01-01", "2023-06-30")
    b = cal.period_features(cal.calendar(spark, 2022, 2024), "2022-01-01", "2023-09-30").where("ds <= '2023-06-30'")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_cleaning_is_causal(spark):
    days = weekdays(120)
    base = [("a", d, None if i in (40, 80) else float(100 + i % 7), 1) for i, d in enumerate(days)]
    spiked = [(s, d, 1e9 if i == 90 else y, b) for i, (s, d, y, b) in enumerate(base)]
    schema = "series_id string, ds date, y double, is_bday int"
    one, two = (clean.causal_impute(spark.createDataFrame(x, schema)).where(F.col("ds") < F.lit(days[90])) for x in (base, spiked))
    assert one.exceptAll(two).count() == 0
    assert one.where("imputed").count() == 2


def test_features_look_back_only(series):
    def built(df):
        return features.ewma(features.robust_trailing(features.trailing(features.lags(df, [1, 5]), [5])))

    changed = series.withColumn("y", F.when(F.col("pos") == 150, 1e9).otherwise(F.col("y")))
    a, b = (built(x).where("pos <= 149") for x in (series, changed))
    assert a.exceptAll(b).count() == 0


def test_embargo(series):
    for r in folds.embargoed_folds(series, 5, 3, 50, 20).collect():
        assert r["eval_start_pos"] - r["train_end_pos"] == 6


def test_holdout_guard(series):
    pn.assert_within(series, "2020-01-01", "2020-12-31", "all")
    with pytest.raises(ValueError):
        pn.assert_within(series, "2020-01-01", "2020-02-01", "part")


def _preds(series, shift):
    w = pn.by_series()
    rows = series.withColumns({"target_date": F.lead("ds", 5).over(w), "y_true": F.lead("y", 5).over(w), "y_pred": F.lead("y", 5 + shift).over(w)})
    return rows.where("y_true IS NOT NULL AND y_pred IS NOT NULL").select("series_id", F.lit("m").alias("model"), F.lit(5).alias("horizon"), F.col("ds").alias("origin_date"), "target_date", F.col("y").alias("origin_value"), "y_true", "y_pred")


@pytest.mark.parametrize("shift,kind", [(0, "ok"), (1, "ok"), (-1, "ok"), (-4, "ok"), (-5, "persistence_like"), (-6, "missing_lag_0"), (-7, "backward"), (-9, "backward"), (-2, "ok"), (3, "forward")])
def test_shift_classes(series, shift, kind):
    got = integrity.shift_diagnostic(_preds(series, shift), integrity.reach(5)).first()
    assert (got["best_shift"], got["shift_class"]) == (shift, kind)
    assert got["naive_equivalent"] == (got["mae_0"] == 0 == got["mae_h"]) or abs(got["mae_0"] - got["mae_h"]) < 0.1 * max(got["mae_0"], got["mae_h"], 1)
    assert integrity.reach(5) == 10 and integrity.reach(20) == 25


def test_lagged_copy_controls(spark, series):
    copy = integrity.lagged_copy(_preds(series, -1)).first()
    assert copy["is_copy"] and copy["best_shift"] == 1
    assert not integrity.lagged_copy(_preds(series, 0)).first()["is_copy"]
    # A shifted forecast that still beats the day before isn't a copy, nor is one without a better shift; baselines and short series say nothing.
    rows = [(i, float(100 * (i % 7 == 0) + i % 3)) for i in range(80)]
    good = spark.createDataFrame([("a", "m", 5, date(2024, 1, 1) + timedelta(days=i), y, y * 0.9) for i, y in rows], "series_id string, model string, horizon int, target_date date, y_true double, y_pred double")
    assert not integrity.lagged_copy(good).first()["is_copy"]
    assert integrity.lagged_copy(good.withColumn("model", F.lit("Naive_last"))).count() == 0
    assert integrity.lagged_copy(good.limit(7)).count() == 0 and integrity.lagged_copy(good.limit(8)).count() == 1


def _folds(spark, maes, model="m", train=None):
    rows = [("s", model, k, 0.0, float(e) * sign) for k, e in enumerate(maes) for sign in (1.0, -1.0)]
    preds = spark.createDataFrame(rows, "series_id string, model string, fold_id int, y_true double, y_pred double")
    training = None if train is None else spark.createDataFrame([("s", model, k, float(t)) for k, t in enumerate(train)], "series_id string, model string, fold_id int, train_mae double")
    return integrity.fold_stability(preds, training).collect()


@pytest.mark.parametrize("maes,train,risk", [
    ([10, 10, 10], None, "low"), ([10, 14, 12], None, "low"), ([10, 20], None, "medium"), ([10, 30], None, "high"), ([10, 11.5, 13], None, "medium"), ([10, 14, 18], None, "high"),
    ([10, 10], [4, 9], "high"), ([10, 10], [21, 10], "medium"), ([10, 10], [6, 9], "low"), ([10], [0.0], "low"),
])
def test_fold_stability_levels(spark, maes, train, risk):
    got = _folds(spark, maes, train=train)[0]
    assert got["risk"] == risk and got["n_folds"] == len(maes)
    if len(maes) > 2:
        import numpy as np

        assert abs(got["slope"] - np.polyfit(np.arange(len(maes)) / (len(maes) - 1), np.array(maes) / np.mean(maes), 1)[0]) < 1e-9
    else:
        assert got["slope"] is None
    assert _folds(spark, maes, "a baseline") == []


def test_preflight_rules(spark):
    day = lambda i: str(date(2024, 1, 1) + timedelta(days=i))
    check = lambda rows, **kw: integrity.preflight(spark.createDataFrame([("s", d, v) for d, v in rows], "series_id string, day string, amount string"), kw.pop("date", "day"), kw.pop("value", "amount"), 5, **kw).first()
    fine = [(day(i), str(100 + i % 5)) for i in range(100)]
    got = check(fine)
    assert (got["blockers"], got["warnings"], got["n_values"], got["step_days"]) == ("", "", 100, 1)
    assert check(fine, date="none")["blockers"] == "no_date_column"
    assert check(fine, value="none")["blockers"] == "no_value_column"
    assert check([("x", "1")] * 50)["blockers"] == "no_dates"
    assert check([(d, "n/a") for d, _ in fine])["blockers"] == "not_numeric"
    assert check(fine[:44])["blockers"] == "too_short" and check(fine[:45])["blockers"] == ""
    assert check([(d, "7") for d, _ in fine])["blockers"] == "constant"
    assert check(fine + [("?", "1")])["warnings"] == "undated_rows"
    assert check([(d, None if i % 10 == 0 else v) for i, (d, v) in enumerate(fine)])["warnings"] == "missing_values"
    assert check(fine + fine[:1])["warnings"] == "repeated_dates"
    apart = fine[:50] + [(day(i + 10), v) for i, (_, v) in enumerate(fine[50:], 50)]
    assert check(apart)["warnings"] == "gaps" and check(apart, cadence="weekly")["warnings"] == ""
    assert check([(d, "9999" if i == 90 else v) for i, (d, v) in enumerate(fine)])["warnings"] == "outliers"


def test_feature_leaks(spark):
    rows = [("s", f, i, v) for i in range(12) for f, v in (("lag_1", float(i % 3)), ("lag_-1", 0.0), ("y.shift(-2)", 1.0), ("knows", 2.0 * (i * 7 % 5)))]
    aim = spark.createDataFrame([("s", i, float(i * 7 % 5)) for i in range(12)], "series_id string, pos int, target double")
    got = {r["feature"]: (r["suspicious_name"], r["leaks"]) for r in integrity.feature_leakage(spark.createDataFrame(rows, "series_id string, feature string, pos int, value double"), aim).collect()}
    assert got == {"lag_1": (False, False), "lag_-1": (True, True), "y.shift(-2)": (True, True), "knows": (False, True)}
    assert not any(r["leaks"] for r in integrity.feature_leakage(spark.createDataFrame([r for r in rows if r[1] == "knows" and r[2] < 10], "series_id string, feature string, pos int, value double"), aim).collect())


def test_recommendations(spark):
    import math

    def made(error, model="m", horizon=5, band=None):
        days = weekdays(120)
        y = [1000 + 300 * math.sin(i / 3) for i in range(125)]
        rows = [("s", model, horizon, days[i], days[i], y[i], y[i + 5], y[i + 5] * (1 + error * (-1) ** i), *((None, None) if band is None else (y[i + 5] - band, y[i + 5] + band))) for i in range(115)]
        return spark.createDataFrame(rows, "series_id string, model string, horizon int, origin_date date, target_date date, origin_value double, y_true double, y_pred double, y_lo double, y_hi double")

    grade = lambda e, **kw: ensemble.recommend(made(e, **kw), folds=3).first()
    assert [grade(e)["grade"] for e in (0.02, 0.06, 0.1, 0.14, 0.3)] == ["A", "B", "C", "D", "F"]
    a = grade(0.02, horizon=20, band=1.0)
    assert (a["flags"], a["tips"], a["next_steps"], a["gate_failed"]) == ("", "wide_intervals,good_months,long_horizon", "ensemble_of_best", False)
    worse = made(0.0).withColumn("y_pred", F.col("origin_value") * 0.5)
    got = ensemble.recommend(worse, integrity.shift_diagnostic(worse, 10)).first()
    assert got["grade"] == "F" and got["gate_failed"] and {"worse_than_persistence", "negative_r2", "shifted"} <= set(got["flags"].split(",")) and got["next_steps"] == "more_folds"
    both = made(0.1).unionByName(made(0.0, "a baseline"))
    assert ensemble.recommend(both).first()["best"] == "m" and ensemble.recommend(made(0.0, "Persistence")).first()["best"] == "Persistence"


def test_family_verdicts(spark):
    scores = spark.createDataFrame([("s", 5, "m", 1.0, 20.0, 0.85), ("s", 5, "q", 1.0, 20.0, 0.5), ("s", 5, "bad", 1.0, 2.0, None), ("s", 5, "leak", 1.0, 30.0, None), ("s", 5, "copy", 1.0, 30.0, None)], "series_id string, horizon int, model string, mae double, skill double, coverage double")
    checks = scores.select("series_id", "horizon", "model", (F.col("model") == "leak").alias("leaks"), (F.col("model") == "copy").alias("shifted"), F.when(F.col("model") == "bad", False).alias("has_signal"))
    names = {"m": "fitted", "q": "quantile", "bad": "weak", "leak": "leaky", "copy": "lagged"}
    got = {r["family"]: (r["reasons"], r["verdict"]) for r in ensemble.family_summary(scores, names, checks).collect()}
    assert got == {"fitted": ("", "pass"), "quantile": ("failed_quality:1", "fail"), "weak": ("failed_quality:1", "fail"), "leaky": ("leakage:1", "fail"), "lagged": ("persistence_like:1", "fail")}
    taught = {r["family"]: r["reasons"] for r in ensemble.family_verdicts(scores, names, checks, trained=("weak",)).collect()}
    assert taught["weak"] == "failed_quality,no_signal"
    assert {r["family"]: r["verdict"] for r in ensemble.family_summary(scores, names).collect()}["fitted"] == "unverified"
    text = runs.report(ensemble.family_summary(scores, names, checks), "train to 1999")
    assert text.startswith("# train to 1999") and "| leaky | 1 | 0 | leak | 30.00 |  | leakage:1 | fail |" in text and text.endswith("pass: 1, partial: 0, fail: 4, unverified: 0")


def test_verdicts_of_series_of_different_scale(spark):
    """A small series doesn't decide for a large one, and one that fails doesn't fail the others."""
    rows = [("small", 5, "m", 0.01, 40.0), ("small", 5, "n", 0.02, 30.0), ("large", 5, "m", 9e6, -3.0), ("large", 5, "n", 1e6, 20.0), ("third", 5, "m", 5.0, 1.0), ("third", 5, "n", 6.0, 0.5)]
    scores = spark.createDataFrame([(*r, None) for r in rows], "series_id string, horizon int, model string, mae double, skill double, coverage double")
    checks = scores.select("series_id", "horizon", "model", F.lit(False).alias("leaks"), F.lit(False).alias("shifted"))
    own = {r["series_id"]: (r["best"], r["verdict"]) for r in ensemble.family_verdicts(scores, {"m": "f", "n": "f"}, checks).collect()}
    assert own == {"small": ("m", "pass"), "large": ("n", "pass"), "third": ("m", "fail")}
    s = ensemble.family_summary(scores, {"m": "f", "n": "f"}, checks).first()
    assert (s["n"], s["n_passed"], s["best"], s["best_skill"], s["reasons"], s["verdict"]) == (3, 2, "m", 20.0, "failed_quality:1", "partial")


def test_rules_find_what_is_planted(spark):
    """Each rule counts its own violations, within a limit or beyond it."""
    days = [date(2024, 4, 29) + timedelta(days=k) for k in range(14)]
    holy = {date(2024, 5, k) for k in (1, 3, 4, 5, 6)}
    good = [("a", d, 0.0 if d.weekday() > 4 or d in holy else 5.0, int(d.weekday() > 4), int(d in holy)) for d in days]
    schema = "series_id string, ds date, y double, is_weekend int, is_holiday int"
    count = lambda rows, **kw: {r["rule"]: (r["violations"], r["holds"]) for r in clean.assertions(spark.createDataFrame(rows, schema), clean.rules(**kw)).collect()}
    assert all(v == (0, True) for v in count(good).values())
    change = lambda at, k, v: [(*r[:k], v, *r[k + 1 :]) if r[1] == at else r for r in good]
    for rows, rule in (
        ([r for r in good if r[1] != days[1]], "daily_continuity"), ([*good, good[0]], "repeated_days"), (change(days[0], 3, 1), "weekend_flag"), (change(days[2], 4, 2), "holiday_flag"),
        (change(date(2024, 5, 3), 4, 0), "known_holidays"), (change(days[1], 2, None), "missing_business_days"), (change(date(2024, 5, 5), 2, 7.0), "nonzero_other_days"),
    ):
        assert count(rows)[rule] == (1, False), rule
    assert count(change(days[1], 4, 1), workdays=["2024-04-30"])["known_workdays"] == (1, False)
    assert count(change(days[1], 2, None), missing_allowed=1)["missing_business_days"] == (1, True)


def test_exact_ewma(spark):
    """All values count, over nulls and over many blocks of positions, as pandas has it."""
    import numpy as np
    import pandas as pd

    r = np.random.default_rng(2)
    y = pd.Series(r.normal(size=1500)).mask(pd.Series(r.random(1500) < 0.2))
    y[:3] = np.nan
    y[200:900] = np.nan
    panel = spark.createDataFrame([("a", i, None if np.isnan(v) else float(v)) for i, v in enumerate(y)], "series_id string, pos int, y double")
    got = {row["pos"]: row["ewm_2"] for row in features.ewma(panel, (2,)).collect()}
    want = y.shift(1).ewm(halflife=2, min_periods=2).mean()
    for i, w in enumerate(want):
        n = y[:i].notna().sum()
        assert (got[i] is None) == (n < 2)
        if n >= 2 and i < 300 or i > 905:
            assert abs(got[i] - w) < 1e-9


def test_date_shares_by_ranges(spark):
    """Steps are counted over the whole file order, however rows are dealt out."""
    days = [date(2020, 1, 1) + timedelta(days=(i * 7) % 50) for i in range(400)]
    rows = spark.createDataFrame([(i, str(d), None if i % 3 else str(d), "x") for i, d in enumerate(days)], "n int, a string, b string, c string").repartition(7)
    got = {r["column"]: r for r in ledger.date_shares(rows, "n").collect()}
    want = sum(x <= y for x, y in zip(days, days[1:])) / 399
    assert abs(got["a"]["rising"] - want) < 1e-12 and got["a"]["parsed"] == 1.0 and abs(got["a"]["score"] - (0.7 + 0.3 * want)) < 1e-12
    assert got["b"]["score"] is None and got["c"]["parsed"] == 0.0


def test_suspicious_zeros_of_levels_and_flows(spark):
    rows = [("pos", i, 0.0 if i == 29 else 5.0) for i in range(30)] + [("neg", i, 0.0 if i == 29 else -5.0) for i in range(30)]
    panel = spark.createDataFrame(rows, "series_id string, pos int, y double")
    blank = lambda **kw: {r["series_id"] for r in pn.suspicious_zeros(panel, **kw).where("y IS NULL").collect()}
    assert blank() == {"pos"} and blank(level=True) == {"pos", "neg"}


def test_ops_and_holidays(spark, tmp_path):
    spark.createDataFrame([("2024-01-01", "x"), ("2024-01-01", "y"), ("soon", "z"), (None, "w")], "Date string, name string").write.csv(str(tmp_path / "h.csv"), header=True)
    assert [r["ds"] for r in ledger.read_holidays(spark, str(tmp_path / "h.csv")).collect()] == [date(2024, 1, 1)]
    spark.createDataFrame([(1,)], "other int").write.parquet(str(tmp_path / "none"))
    assert ledger.read_holidays(spark, str(tmp_path / "none")).count() == 0
    assert ledger.load_outputs(spark, str(tmp_path)) is None


@pytest.fixture(scope="module")
def wave(spark):
    import math

    days = weekdays(420)
    return spark.createDataFrame([(s, d, i, 100.0 + 40 * math.sin(i / 5) + (i * 37 % 11) + k) for k, s in enumerate("ab") for i, d in enumerate(days)], "series_id string, ds date, pos int, y double"), days


@pytest.mark.parametrize("make", [models.boosted_quantiles, models.out_of_bag_bands, models.quantile_forest])
def test_quantile_models(wave, make):
    """Quantiles are in order, cover about what they say, and every target of the range has one row."""
    panel, days = wave
    got = make(panel, days[319], days[320], days[-1], 5).collect()
    assert len(got) == 200 and all(r["p10"] <= r["p50"] <= r["p90"] for r in got)
    inside = sum(r["p10"] <= r["y_true"] <= r["p90"] for r in got) / 200
    assert 0.5 <= inside <= 1.0 and sum(abs(r["p50"] - r["y_true"]) for r in got) / 200 < 15


def test_boosting_by_absolute_error(wave):
    panel, days = wave
    fold = [(1, days[319], days[320], days[-1])]
    got = models.fold_forecasts(panel, fold, 5, ["boosted_l1", "ridge"])
    mae = {r["model"]: r["mae"] for r in ensemble.model_errors(got).groupBy("model").agg(F.avg("mae").alias("mae")).collect()}
    assert got.groupBy("series_id", "model").count().where("count <> 100").count() == 0 and mae["boosted_l1"] < 15


def test_monotone(spark):
    got = spark.createDataFrame([(3.0, 1.0, 2.0)], "a double, b double, c double").withColumns(models.monotone(["a", "b", "c"])).first()
    assert tuple(got) == (3.0, 3.0, 3.0)


def test_calendar_regressors():
    import numpy as np

    got = rolling.calendar_rows(np.array(["2024-03-28", "2024-03-29", "2024-04-30", "2024-05-01"], "datetime64[D]"))
    assert got[:, 7].tolist() == [0, 1, 1, 0] and got[:, 8].tolist() == [0, 1, 0, 0] and got[:, :7].argmax(axis=1).tolist() == [3, 4, 1, 2]


def test_ets_chooses_by_evidence():
    """A season, a trend, or neither, as the values have it."""
    import numpy as np

    r = np.random.default_rng(1)
    season = 50 + np.tile([0.0, 8, -3, 5, -10], 40) + r.normal(scale=0.3, size=200)
    assert abs(models.REGISTRY["ets"](season, 5) - (50 + np.array([0.0, 8, -3, 5, -10]))).max() < 2
    flat = 50 + r.normal(size=200)
    assert abs(models.REGISTRY["ets"](flat, 5) - 50).max() < 1.5 and np.ptp(models.REGISTRY["ets"](flat, 5)) < 1e-9


def test_misaligned_rows_are_found(series):
    good = _preds(series, 0)
    assert [r["fault"] for r in integrity.alignment(good, series).collect()] == ["ok"]
    bad = good.withColumn("target_date", F.date_add("target_date", F.when(F.weekday("target_date") == 4, 3).otherwise(1)))
    assert "misaligned" in [r["fault"] for r in integrity.alignment(bad, series).collect()]


def test_skill_needs_a_baseline(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0)], "m double, b double")
    assert [r[0] for r in df.select(metrics.skill("m", "b")).collect()] == [50.0, None]


def test_signal_control(spark):
    days = weekdays(500)
    rows = [("a", d, i, float(100 * ((i % 5) == 2) + i % 3)) for i, d in enumerate(days)]
    found = models.signal_control(spark.createDataFrame(rows, "series_id string, ds date, pos int, y double"), days[350], 5).collect()
    assert all(r["has_signal"] for r in found)


def test_registry_forecasters_return_all_steps():
    import numpy as np

    y = np.array([float(10 + 3 * (i % 5)) for i in range(120)])
    for name, f in models.REGISTRY.items():
        out = f(y, 5)
        assert len(out) == 5 and np.isfinite(out).all(), name
    assert abs(models.REGISTRY["ets"](y, 5) - y[:5]).max() < 1.0
    assert abs(models.REGISTRY["arx"](y, 5) - y[:5]).max() < 0.5


def test_rolling_forecasts_equal_refits():
    import numpy as np

    y = np.random.default_rng(3).normal(size=120).cumsum() + np.tile([0.0, 3, 1, 5, 2], 24) + 50
    ends = np.arange(1, 121)
    assert set(models.ROLLING) == set(models.REGISTRY)
    for name, f in models.ROLLING.items():
        for h in (1, 5, 7):
            assert np.allclose(f(y, h, ends), [models.REGISTRY[name](y[:n], h)[-1] for n in ends], rtol=1e-6), (name, h)


def test_grouped_forecasts_have_every_origin(spark):
    days = weekdays(1500)
    rows = [("a", d, i, float((i * 37) % 101 + (i > 600) * 50)) for i, d in enumerate(days)] + [("b", d, i, float(i)) for i, d in enumerate(days[:30])]
    panel = spark.createDataFrame(rows, "series_id string, ds date, pos int, y double")
    got = models.grouped_forecasts(panel, 5, ["naive_last", "theta"]).collect()
    a = {r["target_date"]: r for r in got if r["series_id"] == "a" and r["model"] == "theta"}
    assert set(a) == {d for d in days if d.year >= 2024}  # four years before the first fold, and all after
    y = [r[3] for r in rows[:1500]]
    import numpy as np

    k = days.index(max(a)) - 5
    assert a[max(a)]["origin_date"] == days[k] and abs(a[max(a)]["y_pred"] - models.REGISTRY["theta"](np.array(y[: k + 1]), 5)[-1]) < 1e-6
    assert {r["target_date"] for r in got if r["series_id"] == "b"} == set(days[23:30])


def test_fitted_queries_score_all_folds(spark, data):
    from ledgerloom.plans import QUERIES, model_queries

    years = [f[0] for f in model_queries.yearly(model_queries.business_panel(spark, data))]
    assert years == [1999, 2000, 2001]
    for name in ("delta_forecasts", "ablation", "quantile_forest"):
        assert {r["fold_id"] for r in QUERIES[name](spark, data).select("fold_id").distinct().collect()} == set(years), name


def test_wide_reader(spark):
    wide = spark.createDataFrame([("Revenue", "1.5", "x", "n")], "metric string, `2024-01-01` string, `2024-01-02` string, note string")
    assert [tuple(r) for r in ledger.wide_to_long(wide, "metric").orderBy("ds").collect()] == [("Revenue", date(2024, 1, 1), 1.5), ("Revenue", date(2024, 1, 2), None)]


def test_names_are_picked():
    assert ledger.pick_by_name(["id", "Date", "x"], ledger.DATE_NAMES) == "Date"
    assert ledger.pick_by_name(["o_orderdate"], ledger.DATE_NAMES) == "o_orderdate"
    assert ledger.pick_by_name(["q"], ledger.DATE_NAMES) is None


def test_log_refuses_repeats(spark, tmp_path):
    scores = spark.createDataFrame([("a", "m", 5, 1.0, 2.0)], "series_id string, model string, horizon int, mae double, skill double")
    rows = runlog.log_rows(scores, {"k": "v"})
    runlog.append_log(rows, str(tmp_path / "log"))
    assert runlog.check_log(spark, str(tmp_path / "log")).count() == 0
    runlog.append_log(rows, str(tmp_path / "log"))
    assert runlog.check_log(spark, str(tmp_path / "log")).count() == 1


def test_provenance_ignores_order(spark):
    a = spark.createDataFrame([(1, date(2024, 1, 1)), (2, date(2024, 1, 2))], "x int, ds date")
    h = runlog.provenance(a, "ds").first()["content_hash"]
    runlog.verify(a.orderBy(F.col("x").desc()), "ds", h)
    with pytest.raises(ValueError):
        runlog.verify(a.where("x = 1"), "ds", h)


def test_holdout_is_locked(series, tmp_path):
    with pytest.raises(PermissionError):
        runs.read_holdout(series, "2020-06-01", "2020-07-01", " ", str(tmp_path / "log"))
    assert runs.read_holdout(series, "2020-06-01", "2020-06-30", "final score", str(tmp_path / "log")).count() == 22
    assert series.sparkSession.read.json(str(tmp_path / "log")).count() == 1


def test_small_checks(spark, series):
    assert runs.schema_difference(series, series.drop("y").withColumn("pos", F.lit("1")).withColumn("z", F.lit(1))) == {"missing": ["y"], "extra": ["z"], "changed": ["pos"]}
    assert runs.first_columns(series, ["series_id"], 2).columns == ["series_id", "ds", "pos"]
    assert runs.drop_raw_year(series.withColumn("year", F.lit(1))).columns == series.columns


def test_daily_run(spark, series, tmp_path):
    summary = runs.daily_run(series, 5, "2020-08-01", str(tmp_path))
    assert {r["family"] for r in summary.collect()} == {"naive", "average", "statistical", "ensemble"}
    assert runs.report(summary).count("\n| ") == 5
    assert runlog.check_log(spark, str(tmp_path / "log")).count() == 0


def test_daily_run_has_all_families(spark, series, tmp_path):
    days = weekdays(200)
    summary = runs.daily_run(series, 5, "2020-09-01", str(tmp_path), folds=[(2020, date(2020, 8, 31), date(2020, 9, 1), days[-1])])
    assert {r["family"] for r in summary.collect()} == {"naive", "average", "statistical", "fitted", "quantile", "ensemble"}
    preds = spark.read.parquet(f"{tmp_path}/predictions")
    targets = {r["model"]: r["d"] for r in preds.groupBy("model").agg(F.sort_array(F.collect_list("target_date")).alias("d")).collect()}
    assert set(targets) >= set(runs.FAMILIES) and all(d == targets["naive_last"] for d in targets.values())
    assert preds.where("family IN ('statistical', 'quantile') AND (y_lo IS NULL OR y_hi IS NULL)").count() == 0


def test_stream_equals_batch(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    got = rollup.run_rollup(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    batch = rollup.daily_rollup(events)
    assert got.count() > 0 and got.select(sorted(got.columns)).exceptAll(batch.select(sorted(batch.columns))).count() == 0


def test_entry_without_corpus_operators(monkeypatch, spark, data):
    import sys

    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    names = set(entry.queries())
    assert names and not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names
    assert set(entry.oracle_sql()) <= names
