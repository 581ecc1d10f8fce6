"""Feature groups and exogenous blocks: joined when asked for, chosen inside the fold, nothing of the origin's own day."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import calendar
from ledgerloom.operators import groups, models


@pytest.fixture(scope="module")
def panel(spark):
    """``a`` follows what ``lead`` had the day before, ``noise`` nothing; ``late`` goes with ``a`` after 2021 only."""
    days, d = [], date(2020, 1, 6)
    while len(days) < 620:
        if d.weekday() < 5:
            days.append(d)
        d += timedelta(days=1)
    r = np.random.default_rng(1)
    lead, noise = r.normal(size=620), r.normal(size=620)
    a = np.concatenate([[0.0], lead[:-1]]) * 10 + 100 + 15 * np.array([x.day <= 5 for x in days])
    late = np.where(np.array([x.year for x in days]) > 2020, a, r.normal(size=620))
    rows = [(s, d, i, float(v[i])) for s, v in (("a", a), ("lead", lead), ("noise", noise), ("late", late)) for i, d in enumerate(days)]
    return spark.createDataFrame(rows, "series_id string, ds date, pos int, y double").cache(), days


def test_same_day_values_are_refused(panel):
    with pytest.raises(ValueError, match="at least 1"):
        groups.exogenous(panel[0], ["lead"], panel[1][300], lags=(0, 1))
    with pytest.raises(ValueError, match="no series"):
        groups.exogenous(panel[0], ["absent"], panel[1][300])


def test_exogenous_values_are_earlier_ones(panel):
    rows, days = panel
    table, names = groups.exogenous(rows, ["lead", "a"], days[300], top=1, lags=(1, 3))
    assert names == ["x1_lag1", "x1_lag3"]
    lead = {r["pos"]: r["y"] for r in rows.where("series_id = 'lead'").collect()}
    got = {r["ds"]: r for r in table.where("series_id = 'a'").collect()}
    assert len(got) == len(days)
    assert all(got[d]["x1_lag1"] == lead.get(i - 1) and got[d]["x1_lag3"] == lead.get(i - 3) for i, d in enumerate(days))
    changed = rows.withColumn("y", F.when(F.col("pos") >= 400, 1e6).otherwise(F.col("y")))
    later = {r["ds"]: r for r in groups.exogenous(changed, ["lead", "a"], days[300], top=1, lags=(1, 3))[0].where("series_id = 'a'").collect()}
    assert all(later[d] == got[d] for d in days[:401])


def test_selection_is_inside_the_fold(panel):
    """A series that goes with the target in later years only isn't chosen in an earlier fold."""
    rows, days = panel
    early = groups.exogenous(rows, ["late", "noise"], date(2020, 12, 31), top=1, lags=(1,))[0].where("series_id = 'a'")
    full = groups.exogenous(rows, ["late", "noise"], days[-1], top=1, lags=(1,))[0].where("series_id = 'a'")
    late = {r["pos"]: r["y"] for r in rows.where("series_id = 'late'").collect()}
    at = {d: i for i, d in enumerate(days)}
    assert all(r["x1_lag1"] == late.get(at[r["ds"]] - 1) for r in full.collect())
    assert any(r["x1_lag1"] != late.get(at[r["ds"]] - 1) for r in early.collect())


def test_groups_are_joined_when_asked_for(spark, panel):
    rows, _ = panel
    cal = calendar.calendar(spark, 2019, 2023)
    plain, names = models.supervised(rows, 1)
    assert list(groups.GROUPS) == ["A_deadline", "B_holiday", "C_month", "D_aligned_lags", "E_rolling"]
    none, made = groups.with_groups(plain, rows, cal, [])
    assert none.columns == plain.columns and made == {}
    some, made = groups.with_groups(plain, rows, cal, ["A_deadline", "E_rolling"])
    assert some.count() == plain.count() and set(made) == {"A_deadline", "E_rolling"} and not any(c.startswith(("b_", "c_", "d_")) for c in some.columns)
    days = calendar.deadline_features(cal, "2020-01-01", "2022-12-31").select("ds", "is_deadline_monthly")
    both = some.where("target_date IS NOT NULL").join(days, F.col("target_date") == F.col("ds"))
    assert both.where("a_is_deadline_monthly <> is_deadline_monthly").count() == 0  # the target's day, not the origin's


def test_ablation_tells_what_helps(spark, panel):
    """The leading series helps at one step, noise doesn't; each case is there for each fold."""
    rows, days = panel
    cal = calendar.calendar(spark, 2019, 2023)
    got = groups.ablation(rows.where("series_id <> 'late'"), cal, [(1, days[399], days[400], days[499]), (2, days[499], days[500], days[-1])], 2, ["A_deadline", "C_month"], {"lead": ["lead"], "noise": ["noise"]}, lags=(1,)).collect()
    assert {(r["fold_id"], r["added"]) for r in got} == {(k, x) for k in (1, 2) for x in ("nothing", "A_deadline", "C_month", "all groups", "block lead", "block noise")}
    n = {r["added"]: r["n_features"] for r in got if r["fold_id"] == 1}
    assert n["all groups"] == n["A_deadline"] + n["C_month"] - n["nothing"] and n["block lead"] == n["nothing"] + 1
    assert all(r["change_pct"] == 0 for r in got if r["added"] == "nothing")
