"""Rolling forecasters: states carried from block to block give what one task, and what a refit at each origin, gives."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import models, rolling


def values(n, seed=3):
    r = np.random.default_rng(seed)
    return r.normal(size=n).cumsum() * 3 + np.tile([0.0, 30, 10, 50, 20], n // 5 + 1)[:n] + 1e6 + np.where(np.arange(n) > n // 2, 400.0, 0)


@pytest.mark.parametrize("name", sorted(rolling.ROLLING))
@pytest.mark.parametrize("h", [1, 5, 7])
def test_blocks_equal_one_block(name, h):
    """Summaries, a scan over them, and forecasts by block: the same numbers as in one go."""
    f, y = rolling.ROLLING[name], values(900)
    days = np.arange("2015-01-01", "2017-06-19", dtype="datetime64[D]")[:900]
    calendar = np.vstack([rolling.calendar_rows(days), rolling.calendar_rows(days[-h:])])
    cuts = [0, 150, 151, 400, 420, 900]
    for regressors in (calendar, None):
        ahead = lambda ends: None if regressors is None else regressors[ends[:, None] + np.arange(h)]
        ends = np.arange(1, 901)
        whole = f(y, h, ends, None if regressors is None else regressors[:900], ahead(ends))
        state, parts = None, []
        for lo, hi in zip(cuts, cuts[1:]):
            before, own = y[max(0, lo - rolling.LOOKBACK) : lo], None if regressors is None else regressors[lo:hi]
            ends = np.arange(1, hi - lo + 1)
            parts.append(f.forecast(y[lo:hi], before, lo, state, h, ends, own, ahead(lo + ends)))
            state = f.advance(state, f.summary(y[lo:hi], before, lo, own))
        assert np.allclose(np.concatenate(parts), whole, rtol=1e-7, atol=1e-6)


def panel_of(spark, n, gaps=()):
    days, d = [], date(2000, 1, 3)
    while len(days) < n:
        if d.weekday() < 5:
            days.append(d)
        d += timedelta(days=1)
    rows = [("long", d, i, None if i in gaps else float(v)) for i, (d, v) in enumerate(zip(days, values(n)))]
    rows += [("short", d, i, float(i % 7)) for i, d in enumerate(days[:60])] + [("new", d, i, float(i)) for i, d in enumerate(days[:7])]
    return spark.createDataFrame(rows, "series_id string, ds date, pos int, y double")


def test_forecasts_by_block_equal_those_by_series(spark):
    """Every registered forecaster; gaps at the start, inside and across the end of a block; series of one block beside one of many."""
    gaps = {*range(0, 90), *range(205, 330), 399, 400, 401, 777}
    panel = panel_of(spark, 1000, gaps)
    one, many = (models.grouped_forecasts(panel, 5, since="2000-01-10", block=b).toPandas() for b in (5000, 100))
    keys = ["series_id", "model", "origin_date"]
    one, many = (x.sort_values(keys).reset_index(drop=True) for x in (one, many))
    assert len(one) == len(many) and set(one["model"]) == set(rolling.REGISTRY)
    for c in [*keys, "target_date", "origin_value", "y_true"]:
        assert one[c].equals(many[c]), c
    assert np.allclose(one["y_pred"], many["y_pred"], rtol=1e-7)
    assert len(one[one["series_id"] == "long"]) == 5 * sum(1 for i in range(1000) if i not in gaps and 5 <= i + 5 < 1000)


def test_a_long_series_spreads_over_groups(spark):
    """Rows are grouped by block; only summaries are grouped by series."""
    out = models.grouped_forecasts(panel_of(spark, 600), 5, since="2000-01-10", block=100)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    over_rows = [x for x in plan.split("\n") if "FlatMapCoGroupsInPandas" in x]
    assert len(over_rows) == 2 and all("[series_id" in x and ", block" in x for x in over_rows)
    alone = [x for x in plan.split("\n") if "FlatMapGroupsInPandas" in x]
    assert alone and not any(" pos#" in x or "first#" in x for x in alone)


def test_plug_in_without_a_rolling_form(spark, monkeypatch):
    monkeypatch.setitem(rolling.REGISTRY, "half", lambda y, h: np.full(h, y[-1] / 2))
    panel = panel_of(spark, 40)
    got = models.grouped_forecasts(panel, 5, ["half", "naive_last"], since="2000-01-10").groupBy("series_id", "origin_date").pivot("model", ["half", "naive_last"]).agg(F.first("y_pred")).collect()
    assert got and all(r["half"] == r["naive_last"] / 2 for r in got)
