"""Faults that the findings of round 3 name."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import calendar
from ledgerloom.operators import groups, models, trees
from ledgerloom.plans.registry import business_panel
from ledgerloom.sources import ledger

FOLDS = [(2000, date(1999, 12, 31), date(2000, 1, 1), date(2000, 12, 31))]


def test_value_guess_passes_over_keys(spark):
    rows = spark.range(5000).selectExpr("id + 1000000 AS o_orderkey", "cast(id % 700 AS string) AS amount", "'x' AS note")
    got = {r["column"]: (r["rank"], r["p90"]) for r in ledger.value_shares(rows).collect()}
    assert {c: r for c, (r, _) in got.items()} == {"amount": 1, "o_orderkey": 2, "note": 3}
    assert got["amount"][1] == pytest.approx(np.quantile(np.arange(5000) % 700, 0.9), abs=1e-6)
    assert got["o_orderkey"][1] == pytest.approx(1000000 + 0.9 * 4999, abs=1e-6) and got["note"][1] is None


@pytest.mark.parametrize("width", [1e-9, 2e-4, 1.0])
def test_percentiles_are_exact(spark, width):
    values = np.random.default_rng(1).lognormal(size=40_000).round(2)
    rows = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(7).withColumns({"none": F.lit(None).cast("double"), "same": F.lit(4.0)})
    for q in (0.0, 0.25, 0.9, 1.0):
        got = ledger.percentiles(rows, ["v", "none", "same"], q, width)
        assert got["v"] == pytest.approx(np.quantile(values, q), abs=1e-6) and got["none"] is None and got["same"] == 4.0
    assert ledger.percentiles(rows.limit(0), ["v"], 0.9) == {"v": None}


@pytest.fixture(scope="module")
def panel(spark, data, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("panel") / "rows")
    business_panel(spark, data).write.parquet(path)
    return spark.read.parquet(path)


def test_forecasts_read_stored_features(panel):
    out = models.fold_forecasts(panel, FOLDS, 5, ["ridge", "lasso"])
    assert out.count() and not set(out.inputFiles()) & set(panel.inputFiles())


def test_group_ablation_reads_stored_rows(spark, panel):
    names = sorted(r["series_id"] for r in panel.select("series_id").distinct().collect())
    out = groups.ablation(panel, calendar.calendar(spark, 1995, 2001), FOLDS, 5, groups=["C_month"], blocks={"cross": names})
    assert out.count() == 3 and not set(out.inputFiles()) & set(panel.inputFiles())


def test_sums_of_few_partitions_take_no_shuffle(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(bytes(rng.integers(0, 64, 4, dtype=np.uint8)), float(rng.normal())) for _ in range(500)], "x binary, label double").repartition(3)
    made = trees.Trees.blank(2, 2)

    def work(batch, x):
        return np.ones((len(x), 2)), np.repeat(batch.column(1).to_numpy()[:, None], 2, axis=1)

    for level in range(2):
        one, other = (trees.level_sums(rows, made, level, 4, work, parts) for parts in (3, None))
        assert all(np.allclose(a, b) for a, b in zip(one, other)) and one[0].sum() == 2 * 4 * 500
        trees.split(made, level, *one, 5)


def test_trees_send_rows_without_a_split_left():
    made = trees.Trees(np.array([[0, -1, 1]]), np.array([[5, 9, 7]]), np.array([[1.0, 2.0, 3.0, 4.0]]))
    assert made.predict(np.array([[5, 9], [5, 200], [6, 7], [6, 8]])).ravel().tolist() == [1.0, 1.0, 3.0, 4.0]
