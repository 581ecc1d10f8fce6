"""Forecasters fitted by Spark ML over all series; per-series forecasters of the registry in ``rolling``."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.feature import FeatureHasher, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import folds, rolling, trees
from .panel import by_series
from .rolling import REGISTRY, ROLLING
from .work import forget

LAGS, WINDOWS = [1, 2, 5, 10, 20], [5, 20]
#: Features that series are hashed to, however many there are.
HASHED = 64
#: Fits that are submitted at once.
AT_ONCE = 4


def supervised(panel: DataFrame, horizon: int, delta: bool = False) -> tuple[DataFrame, list[str]]:
    """Features at each origin and the value ``horizon`` on (its change for levels), and the features' names.

    All windows share one partition and order, so Spark sorts once.
    """
    w = by_series()
    columns = {f"lag_{k}": F.lag("y", k).over(w) for k in LAGS} | {"now": F.col("y")}
    columns |= {f"mean_{k}": F.avg("y").over(w.rowsBetween(-k, -1)) for k in WINDOWS} | {f"std_{k}": F.stddev_pop("y").over(w.rowsBetween(-k, -1)) for k in WINDOWS}
    columns |= {"dow": F.weekday("ds").cast("double"), "dom": F.dayofmonth("ds").cast("double"), "month": F.month("ds").cast("double")}
    ahead = F.lead("y", horizon).over(w)
    rows = panel.withColumns(columns | {"target_date": F.lead("ds", horizon).over(w), "y_true": ahead, "label": ahead - F.col("y") if delta else ahead})
    return rows.withColumnsRenamed({"ds": "origin_date"}).withColumn("origin_value", F.col("y")), list(columns)


def estimators(seed: int = 13) -> dict[str, object]:
    common = {"featuresCol": "features", "labelCol": "label", "predictionCol": "raw"}
    return {
        "ridge": LinearRegression(regParam=1.0, elasticNetParam=0.0, **common),
        "lasso": LinearRegression(regParam=10.0, elasticNetParam=1.0, maxIter=50, **common),
        "elastic_net": LinearRegression(regParam=10.0, elasticNetParam=0.5, maxIter=50, **common),
        "random_forest": RandomForestRegressor(numTrees=30, maxDepth=7, minInstancesPerNode=5, seed=seed, **common),
        "boosted_l2": GBTRegressor(maxIter=20, maxDepth=4, lossType="squared", seed=seed, **common),
        "boosted_l1": GBTRegressor(maxIter=20, maxDepth=4, lossType="absolute", seed=seed, **common),
    }


def pipeline(names: list[str], estimator) -> Pipeline:
    """Median imputation, scaling (fitted on the training rows alone), the series' hashed marks, then the estimator."""
    filled = [f"{n}_f" for n in names]
    return Pipeline(
        stages=[
            Imputer(strategy="median", inputCols=names, outputCols=filled),
            VectorAssembler(inputCols=filled, outputCol="numbers"),
            StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True, withStd=True),
            FeatureHasher(inputCols=["series_id"], outputCol="series_hot", numFeatures=HASHED),
            VectorAssembler(inputCols=["scaled", "series_hot"], outputCol="features"),
            estimator,
        ]
    )


def together(work: list[Callable]) -> list:
    """What the calls return, a few of them submitted at once so that small fits share the cluster."""
    with ThreadPool(AT_ONCE) as pool:
        return pool.map(inheritable_thread_target(SparkSession.getActiveSession())(lambda f: f()), work)


def kept(rows: DataFrame) -> DataFrame:
    """``rows`` written once, in partitions of about ``trees.ROWS`` rows, so that no fit makes them again from the tables they come from."""
    once = trees.stored(rows)
    out = trees.stored(once, once.count())
    forget(once)
    return out


def parts_of(rows: DataFrame, train_end, start, end) -> tuple[Column, Column]:
    """Which rows are trained on and which are scored: labels end before the first scored origin."""
    inside = F.col("target_date").between(F.lit(start), F.lit(end))
    first = rows.where(inside).agg(F.min("origin_date")).first()[0]
    return F.col("target_date") <= F.lit(min(train_end, first) if first is not None else train_end), inside


def parted(rows: DataFrame, train_end, start, end) -> tuple[DataFrame, DataFrame]:
    """Training and scored rows."""
    learnt, inside = parts_of(rows, train_end, start, end)
    return rows.where(learnt), rows.where(inside)


SCORED = ["series_id", "origin_date", "target_date", "origin_value", "y_true"]


def fold_forecasts(panel: DataFrame, folds: list[tuple], horizon: int, models: list[str], delta: bool = False) -> DataFrame:
    """Forecasts of each model for each fold's evaluation range: fitted once per fold, all origins scored in one pass.

    ``folds``: ``(fold_id, train_end, eval_start, eval_end)``. Training labels
    end before the first scored origin, so nothing known later is learnt.
    Features are stored once, and a fold's training rows are kept while its models are fitted, and released.
    """
    rows, names = supervised(panel, horizon, delta)
    rows = kept(rows.where("label IS NOT NULL"))
    made, out = estimators(), None
    for fold_id, train_end, start, end in folds:
        train, scored = parted(rows, train_end, start, end)
        train = train.select("series_id", "label", *names).persist()
        fitted = together([lambda name=name: pipeline(names, made[name]).fit(train) for name in models])
        train.unpersist()
        value = F.col("raw") + F.col("y") if delta else F.col("raw")
        for name, model in zip(models, fitted):
            own = model.transform(scored).select("series_id", F.lit(name).alias("model"), F.lit(horizon).alias("horizon"), F.lit(fold_id).alias("fold_id"), "origin_date", "target_date", "origin_value", "y_true", value.alias("y_pred"))
            out = own if out is None else out.unionByName(own)
    return out


def _folded(panel: DataFrame, folds: list[tuple], horizon: int) -> tuple[DataFrame, DataFrame, int]:
    """``(training rows, rows to score, features)``, both stored with binned features.

    ``folds``: ``(fold_id, train_end, eval_start, eval_end)``. Training rows have
    a bit in ``fits`` for each fold whose training they belong to: labels end
    before the fold's first scored origin. Rows to score are there once for each
    fold, whose place in the list is ``part``. Bins are those of the rows that the earliest fold learns from.
    """
    rows, names = supervised(panel, horizon)
    rows = rows.where("label IS NOT NULL").withColumn("series_mark", F.pmod(F.xxhash64("series_id"), F.lit(HASHED)))
    names = [*names, "series_mark"]
    inside = [F.col("target_date").between(F.lit(start), F.lit(end)) for _, _, start, end in folds]
    found = rows.agg(*[F.min(F.when(c, F.col("origin_date"))).alias(f"o{k}") for k, c in enumerate(inside)], F.count("*").alias("n")).first()
    ends = [min(fold[1], found[k]) if found[k] is not None else fold[1] for k, fold in enumerate(folds)]
    bits = [F.when(F.col("target_date") <= F.lit(end), F.lit(1 << k)).otherwise(0).cast("long") for k, end in enumerate(ends)]
    rows = rows.withColumns({"fits": reduce(lambda a, b: a + b, bits), "rid": F.xxhash64("series_id", "origin_date"), "parts": F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in enumerate(inside)]))})
    edges = trees.bin_edges(rows.where(F.col("target_date") <= F.lit(min(ends))), names)
    binned = trees.stored(trees.with_bins(rows, names, edges, [*SCORED, "label", "fits", "rid", "parts"]), found["n"])
    score = binned.withColumn("part", F.explode("parts")).select(*SCORED, "part", F.get(F.array(*[F.lit(f[0]) for f in folds]), F.col("part")).alias("fold_id"), "x")
    return trees.stored(binned.where("fits > 0").select("rid", "x", "label", "fits"), found["n"]), score, len(names)


def _one_fold(many: Callable) -> Callable:
    """The function of one fold, ``(panel, train_end, start, end, horizon, ...)``, without the fold's number."""

    def one(panel: DataFrame, train_end, start, end, horizon: int, **more) -> DataFrame:
        return many(panel, [(0, train_end, start, end)], horizon, **more).drop("fold_id")

    one.__doc__ = many.__doc__
    return one


def quantile_forest_folds(panel: DataFrame, folds: list[tuple], horizon: int, quantiles=(0.1, 0.5, 0.9), n_trees: int = 30, depth: int = 6, points: int = 100) -> DataFrame:
    """Quantiles of the training targets that share a row's leaves, by fold; each tree weighs the same.

    The targets of a leaf are summed up by ``points`` quantiles, so the forest
    has a fixed size, and goes to where rows are scored: in one projection,
    without a row for each tree.
    """
    train, score, width = _folded(panel, folds, horizon)
    forest = trees.grow_forest(train, width, list(range(len(folds))), n_trees, depth, least=10)
    steps = [(k + 0.5) / points for k in range(points)]
    pools = np.zeros((len(folds) * n_trees, 2**depth, points))
    for r in trees.leaf_quantiles(train, forest, width, list(range(len(folds))), steps).collect():  # a row for each leaf
        pools[divmod(r["cell"], 2**depth)] = r["at"]
    shared = panel.sparkSession.sparkContext.broadcast((forest, pools))  # folds x trees x leaves x points numbers

    def add(x: np.ndarray, part: np.ndarray) -> np.ndarray:
        forest, pools = shared.value
        mine = part[:, None] * n_trees + np.arange(n_trees)[None, :]
        leaf = np.take_along_axis(forest.node(x, depth), mine, axis=1)
        return np.quantile(pools[mine, leaf].reshape(len(x), -1), quantiles, axis=1).T

    return trees.scored(score, width, add, [f"p{int(q * 100)}" for q in quantiles]).drop("part")


quantile_forest = _one_fold(quantile_forest_folds)


def monotone(columns: list[str]) -> dict[str, Column]:
    """The columns, each at least as large as those before it."""
    return {c: F.greatest(*columns[: i + 1]) if i else F.col(c) for i, c in enumerate(columns)}


def boosted_quantile_folds(panel: DataFrame, folds: list[tuple], horizon: int, quantiles=(0.1, 0.5, 0.9), rounds: int = 100, rate: float = 0.1, depth: int = 3) -> DataFrame:
    """Quantiles by gradient boosting under the pinball loss, in order, by fold; the models of all folds and quantiles are grown by the same jobs."""
    train, score, width = _folded(panel, folds, horizon)
    models = [(k, q) for k in range(len(folds)) for q in quantiles]
    start, made = trees.boost(train, width, [k for k, _ in models], [q for _, q in models], rounds, rate, depth, least=10)
    shared = panel.sparkSession.sparkContext.broadcast((start, made))

    def add(x: np.ndarray, part: np.ndarray) -> np.ndarray:
        start, made = shared.value
        f = np.tile(start, (len(x), 1))
        for t in made:
            f += t.predict(x)
        own = f.reshape(len(x), len(folds), len(quantiles))[np.arange(len(x)), part]
        return np.maximum.accumulate(own, axis=1)

    return trees.scored(score, width, add, [f"p{int(q * 100)}" for q in quantiles]).drop("part")


boosted_quantiles = _one_fold(boosted_quantile_folds)


def out_of_bag_band_folds(panel: DataFrame, folds: list[tuple], horizon: int, quantiles=(0.1, 0.5, 0.9), n_trees: int = 60, depth: int = 7) -> DataFrame:
    """A forest's forecast moved by quantiles of its out-of-bag residuals, in order, by fold.

    Each tree draws rows by weights from a hash of row and tree, so it is known
    of every row which trees haven't seen it; their mean gives its residual.
    In-sample residuals would make the bands far too narrow.
    """
    train, score, width = _folded(panel, folds, horizon)
    bits = list(range(len(folds)))
    forest = trees.grow_forest(train, width, bits, n_trees, depth, least=5)
    steps = F.array(*[F.lit(q) for q in quantiles])
    moves = np.zeros((len(folds), len(quantiles)))
    for r in trees.out_of_bag(train, forest, width, bits).groupBy("part").agg(F.percentile_approx("e", steps, F.lit(10_000)).alias("at")).collect():  # a row for each fold
        moves[r["part"]] = r["at"]
    shared = panel.sparkSession.sparkContext.broadcast(forest)

    def add(x: np.ndarray, part: np.ndarray) -> np.ndarray:
        value = shared.value.predict(x).reshape(len(x), len(folds), n_trees)[np.arange(len(x)), part].mean(axis=1)
        return np.maximum.accumulate(value[:, None] + moves[part], axis=1)

    return trees.scored(score, width, add, [f"p{int(q * 100)}" for q in quantiles]).drop("part")


out_of_bag_bands = _one_fold(out_of_bag_band_folds)


def residual_bands(preds: DataFrame, calibration_end, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Bounds from quantiles of residuals of a held tail (rows up to ``calibration_end``), in order with the point forecast."""
    e = F.col("y_true") - F.col("y_pred")
    keys = ["series_id", "model"]
    bands = preds.where(F.col("target_date") <= F.lit(calibration_end)).groupBy(*keys).agg(F.percentile(e, F.lit(low)).alias("__lo"), F.percentile(e, F.lit(high)).alias("__hi"))
    out = preds.where(F.col("target_date") > F.lit(calibration_end)).join(bands, keys, "left")
    held = F.col("__lo").isNotNull()  # no bounds without a tail
    return out.withColumns({"y_lo": F.when(held, F.least("y_pred", F.col("y_pred") + F.col("__lo"))), "y_hi": F.when(held, F.greatest("y_pred", F.col("y_pred") + F.col("__hi")))}).drop("__lo", "__hi")


def importances(panel: DataFrame, train_end, horizon: int, top: int = 10) -> DataFrame:
    """Features by importance in a forest, the most important first."""
    rows, names = supervised(panel, horizon)
    rows = rows.where("label IS NOT NULL").where(F.col("target_date") <= F.lit(train_end))
    fitted = pipeline(names, RandomForestRegressor(numTrees=20, maxDepth=6, seed=3, featuresCol="features", labelCol="label")).fit(rows)
    weights = fitted.stages[-1].featureImportances.toArray()
    labels = names + [f"series_mark_{i}" for i in range(len(weights) - len(names))]
    table = rows.sparkSession.createDataFrame([(n, float(x)) for n, x in zip(labels, weights)], "feature string, importance double")
    place = F.row_number().over(Window.orderBy(F.col("importance").desc(), "feature"))
    return table.withColumn("rank", place).where(F.col("rank") <= top)


def signal_control(panel: DataFrame, train_end, horizon: int, seed: int = 5, by: list[str] | None = None) -> DataFrame:
    """Whether features carry signal: error with a shuffled target over error with the true one, for a linear, a tree and a forest probe.

    The shuffle pairs the row numbers by position and by hash. A gap of
    ``horizon`` rows parts training and test. A ratio of 1.5 or more says
    signal; one of 20 or more is alarming, as a target that leaks looks so.
    ``by``: columns (``series_id``) for each of which the ratio is told.
    """
    by = by or []
    rows, names = supervised(panel, horizon)
    rows = rows.where("label IS NOT NULL")
    w = Window.partitionBy("series_id")
    rows = rows.withColumns({"n1": F.row_number().over(w.orderBy("pos")), "n2": F.row_number().over(w.orderBy(F.xxhash64(F.lit(seed), "pos")))})
    other = rows.select("series_id", F.col("n2").alias("n1"), F.col("label").alias("shuffled"))
    both = rows.join(other, ["series_id", "n1"])
    train = both.where(F.col("target_date") <= F.lit(train_end)).persist()
    last = train.agg(F.max("pos")).first()[0]
    test = both.where(F.col("pos") > last + horizon)
    probes = {"linear": LinearRegression(regParam=1.0), "tree": DecisionTreeRegressor(maxDepth=6, minInstancesPerNode=10, seed=1), "forest": RandomForestRegressor(numTrees=20, maxDepth=6, minInstancesPerNode=5, seed=1)}
    cases = [(name, label) for name in probes for label in ("label", "shuffled")]

    def fit(name: str, label: str):
        probe = probes[name].copy().setFeaturesCol("features").setLabelCol("label").setPredictionCol("raw")
        return pipeline(names, probe).fit(train.withColumn("label", F.col(label)))

    fitted = together([lambda c=c: fit(*c) for c in cases])
    train.unpersist()
    errors = None
    for (name, label), model in zip(cases, fitted):
        own = model.transform(test.withColumn("label", F.col(label))).select(*by, F.lit(name).alias("probe"), F.lit(label).alias("aim"), F.abs(F.col("label") - F.col("raw")).alias("e"))
        errors = own if errors is None else errors.unionByName(own)
    out = errors.groupBy(*by, "probe").agg(F.avg(F.when(F.col("aim") == "label", F.col("e"))).alias("mae_true"), F.avg(F.when(F.col("aim") == "shuffled", F.col("e"))).alias("mae_shuffled"))
    ratio = F.when(F.col("mae_true") > 0, F.col("mae_shuffled") / F.col("mae_true")).otherwise(float("inf"))
    return out.withColumn("ratio", ratio).withColumns({"has_signal": F.col("ratio") >= 1.5, "alarm": F.col("ratio") >= 20})


def scaler_statistics(panel: DataFrame, train_end, horizon: int) -> DataFrame:
    """Mean and population deviation (1 where it is 0) of each feature over the training rows."""
    rows, names = supervised(panel, horizon)
    rows = rows.where(F.col("target_date") <= F.lit(train_end))
    long = rows.unpivot(["series_id"], names, "feature", "value")
    sd = F.stddev_pop("value")
    return long.groupBy("feature").agg(F.avg("value").alias("mean"), F.when(sd > 0, sd).otherwise(1.0).alias("std"))


def evaluation_start(panel: DataFrame, horizon: int) -> DataFrame:
    """``series_id, first``: start of each series' first yearly fold; of its last window where it has too few years for one."""
    yearly = folds.yearly_folds(panel).groupBy("series_id").agg(F.min("eval_start").alias("__y"))
    short = folds.last_window(panel, horizon).select("series_id", F.col("eval_start_pos").alias("pos"))
    short = panel.join(short, ["series_id", "pos"]).select("series_id", F.col("ds").alias("__w"))
    return short.join(yearly, "series_id", "left").select("series_id", F.coalesce("__y", "__w").alias("first"))


def grouped_forecasts(panel: DataFrame, horizon: int, names: list[str] | None = None, since: str | None = None, block: int = rolling.BLOCK) -> DataFrame:
    """Registry forecasters, refitted at every origin of the evaluation range on the whole history up to it, in parallel over series and blocks of ``block`` positions.

    The range has all targets from ``since`` on; None: those of all yearly
    folds. Forecasters with a form in ``ROLLING`` visit each value once or
    twice, in tasks of one block; others are refitted at each origin, in a task
    for each series. Null values are passed over, as history and as origins.
    """
    chosen = names or sorted(REGISTRY)
    if since is None:
        rows = panel.join(evaluation_start(panel, horizon), "series_id")
    else:
        rows = panel.withColumn("first", F.lit(since).cast("date"))
    rows = rows.select("series_id", "pos", "ds", "y", "first")
    carried, plain = [n for n in chosen if n in ROLLING], [n for n in chosen if n not in ROLLING]
    parts = [f(rows, horizon, own) for f, own in ((lambda *x: rolling.by_blocks(*x, block), carried), (rolling.by_series, plain)) if own]
    return reduce(DataFrame.unionByName, parts)


def recursive_forecast(step: Callable[[DataFrame], DataFrame], panel: DataFrame, horizon: int, most: int = 20) -> DataFrame:
    """Forecast by feeding one-step forecasts back, for few steps; direct forecasts are the rule."""
    if horizon > most:
        raise ValueError(f"at most {most} steps")
    out = panel
    for _ in range(horizon):
        out = out.unionByName(step(out).select(*panel.columns))
    return out
