"""Histogram trees: boosting and forests over folds, weights by hash, out-of-bag residuals."""

import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import models, trees


def days_of(n, start=date(2020, 1, 6)):
    out, d = [], start
    while len(out) < n:
        if d.weekday() < 5:
            out.append(d)
        d += timedelta(days=1)
    return out


@pytest.fixture(scope="module")
def noisy(spark):
    """A weekly shape with noise that grows with it: quantiles differ from day to day."""
    r = np.random.default_rng(4)
    days = days_of(700)
    rows = [(s, d, i, float(100 + 20 * (i % 5) + k * 10 + r.normal() * (3 + 4 * (i % 5)))) for k, s in enumerate("abc") for i, d in enumerate(days)]
    return spark.createDataFrame(rows, "series_id string, ds date, pos int, y double").cache(), days


def pinball(rows, q, column):
    e = np.array([r["y_true"] - r[column] for r in rows])
    return float(np.maximum(q * e, (q - 1) * e).mean())


def coverage(rows):
    return sum(r["p10"] <= r["y_true"] <= r["p90"] for r in rows) / len(rows)


def test_boosting_learns_what_features_tell(spark):
    """A hundred rounds on a series that is known but for what no feature tells."""
    days = days_of(420)
    panel = spark.createDataFrame([(s, d, i, 100.0 + 40 * math.sin(i / 5) + (i * 37 % 11) + k) for k, s in enumerate("ab") for i, d in enumerate(days)], "series_id string, ds date, pos int, y double")
    at = (days[319], days[320], days[-1])
    boosted, forest = models.boosted_quantiles(panel, *at, 5).collect(), models.quantile_forest(panel, *at, 5).collect()
    assert len(boosted) == len(forest) == 200
    loss = {n: sum(pinball(rows, q, c) for q, c in ((0.1, "p10"), (0.5, "p50"), (0.9, "p90"))) for n, rows in (("boosted", boosted), ("forest", forest))}
    known = [r["y"] for r in panel.where(F.col("ds") <= F.lit(days[319])).collect()]
    flat = sum(pinball([{"y_true": r["y_true"], "c": float(np.quantile(known, q))} for r in boosted], q, "c") for q in (0.1, 0.5, 0.9))
    assert loss["boosted"] < 1.2 * loss["forest"] and loss["boosted"] < flat / 5


def test_boosted_quantiles_cover(noisy):
    panel, days = noisy
    boosted = models.boosted_quantiles(panel, days[549], days[550], days[-1], 5).collect()
    assert len(boosted) == 450 and 0.7 <= coverage(boosted) <= 0.9
    # Widths follow the noise.
    width = {d: np.mean([r["p90"] - r["p10"] for r in boosted if r["target_date"].weekday() == d]) for d in range(5)}
    assert width[4] > 2 * width[0]


def test_out_of_bag_bands_cover(noisy):
    panel, days = noisy
    got = models.out_of_bag_bands(panel, days[549], days[550], days[-1], 5).collect()
    assert len(got) == 450 and 0.75 <= coverage(got) <= 0.85


def test_no_row_is_scored_by_a_tree_that_saw_it(spark, noisy):
    """Residuals of a forest by hand, from the weights alone."""
    panel, days = noisy
    train, _, width = models._folded(panel, [(1, days[549], days[550], days[-1])], 5)
    forest = trees.grow_forest(train, width, [0], 20, 4, least=5)
    rows = train.where("fits > 0").collect()
    rid, label = np.array([r["rid"] for r in rows]), np.array([r["label"] for r in rows])
    x = np.array([list(r["x"]) for r in rows], np.int64)
    weight = trees.bootstrap_weights(rid, np.arange(20))
    value = forest.predict(x)
    want = {}
    for i in range(len(rows)):
        free = weight[i] == 0
        if free.any():
            want[rows[i]["rid"]] = (label[i] - value[i][free].mean(), int(free.sum()))
    got = {r["rid"]: (r["e"], r["votes"]) for r in trees.out_of_bag(train, forest, width, [0]).collect()}
    assert got.keys() == want.keys() and all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1] == want[k][1] for k in want)
    assert 0.33 < (weight == 0).mean() < 0.41 and 0.95 < weight.mean() < 1.05
    # The first tree's first split is that which the drawn rows give.
    w, best = weight[:, 0], None
    f = forest.feature[0, 0]
    for b in range(trees.BINS):
        left = x[:, f] <= b
        if w[left].sum() >= 5 and w[~left].sum() >= 5:
            gain = (w * label)[left].sum() ** 2 / w[left].sum() + (w * label)[~left].sum() ** 2 / w[~left].sum()
            best = gain if best is None else max(best, gain)
    left = x[:, f] <= forest.bin[0, 0]
    assert np.isclose((w * label)[left].sum() ** 2 / w[left].sum() + (w * label)[~left].sum() ** 2 / w[~left].sum(), best)


def test_margins_written_down_change_nothing(noisy, monkeypatch):
    panel, days = noisy
    train, _, width = models._folded(panel, [(1, days[549], days[550], days[-1])], 5)
    made = []
    for every in (2, 100):
        monkeypatch.setattr(trees, "WRITTEN_EVERY", every)
        made.append(trees.boost(train, width, [0, 0], [0.1, 0.9], 5, 0.1, 2, 10))
    (a, one), (b, two) = made
    assert np.array_equal(a, b) and all(np.array_equal(x.feature, y.feature) and np.array_equal(x.bin, y.bin) and np.allclose(x.value, y.value) for x, y in zip(one, two))


def test_folds_side_by_side_equal_folds_alone(noisy):
    """The earliest fold's rows, bins and trees are its own, whatever other folds are grown with it."""
    panel, days = noisy
    folds = [(1, days[399], days[400], days[499]), (2, days[399], days[500], days[599])]
    both = models.boosted_quantile_folds(panel, folds, 5, rounds=4).collect()
    for fold in folds[:1]:
        alone = {(r["series_id"], r["target_date"]): r["p50"] for r in models.boosted_quantiles(panel, *fold[1:], 5, rounds=4).collect()}
        mine = {(r["series_id"], r["target_date"]): r["p50"] for r in both if r["fold_id"] == fold[0]}
        assert alone.keys() == mine.keys() and all(abs(alone[k] - mine[k]) < 1e-9 for k in alone)


def test_nulls_have_a_bin_of_their_own(spark):
    rows = spark.createDataFrame([(i, None if i % 4 == 0 else float(i), float(i % 4 == 0)) for i in range(200)], "rid long, a double, label double")
    edges = trees.bin_edges(rows, ["a"])
    x = np.array([list(r["x"]) for r in trees.with_bins(rows, ["a"], edges, ["rid", "label"]).orderBy("rid").collect()])
    assert (x[::4, 0] == 0).all() and x[1, 0] == 1 and x.max() <= trees.BINS and (np.diff(x[np.arange(200) % 4 > 0, 0]) >= 0).all()


def test_no_rows(spark, noisy):
    panel, days = noisy
    for make in (models.boosted_quantile_folds, models.quantile_forest_folds, models.out_of_bag_band_folds):
        more = {"rounds": 2} if make is models.boosted_quantile_folds else {"n_trees": 2, "depth": 2}
        assert make(panel.where(F.lit(False)), [(1, days[9], days[10], days[20])], 5, **more).count() == 0
