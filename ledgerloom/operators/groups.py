"""Feature groups by name, joined only where they are asked for, exogenous blocks of other series, and what each is worth."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar
from . import features, models
from .panel import correlation

#: Makes ``(features by day or by series and day, names)`` of a panel and the calendar.
Maker = Callable[[DataFrame, DataFrame], tuple[DataFrame, list[str]]]


@dataclasses.dataclass(frozen=True)
class Group:
    """``of_target``: described is the day that is forecast, which the calendar knows ahead; otherwise the origin."""

    make: Maker
    of_target: bool


GROUPS: dict[str, Group] = {}


def group(name: str, of_target: bool = False):
    def add(make: Maker) -> Maker:
        GROUPS[name] = Group(make, of_target)
        return make

    return add


def _span(panel: DataFrame) -> tuple[str, str]:
    first, last = panel.agg(F.min("ds"), F.max("ds")).first()
    return str(first), str(last)


def _of_days(days: DataFrame) -> tuple[DataFrame, list[str]]:
    return days, [c for c in days.columns if c != "ds"]


@group("A_deadline", of_target=True)
def deadline_group(panel: DataFrame, cal: DataFrame):
    return _of_days(calendar.deadline_features(cal, *_span(panel)))


@group("B_holiday", of_target=True)
def holiday_group(panel: DataFrame, cal: DataFrame):
    return _of_days(calendar.holiday_features(cal, *_span(panel)))


@group("C_month", of_target=True)
def month_group(panel: DataFrame, cal: DataFrame):
    return _of_days(calendar.period_features(cal, *_span(panel)).drop("dow", "month"))


@group("D_aligned_lags")
def aligned_group(panel: DataFrame, cal: DataFrame):
    names = ["y_prev_month", "y_prev_year"]
    return features.aligned_lags(panel, calendar.month_position(cal)).select("series_id", "ds", *names), names


@group("E_rolling")
def rolling_group(panel: DataFrame, cal: DataFrame):
    made = features.ewma(features.robust_trailing(panel))
    names = [c for c in made.columns if c not in panel.columns]
    return made.select("series_id", "ds", *names), names


def with_groups(rows: DataFrame, panel: DataFrame, cal: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, list[str]]]:
    """``rows`` of ``models.supervised`` with the features of the groups named, and each group's columns."""
    made = {}
    for name in names:
        g = GROUPS[name]
        table, columns = g.make(panel, cal)
        own = {c: f"{name.split('_')[0].lower()}_{c}" for c in columns}
        table = table.select(*[F.col(c).alias(f"__{c}") for c in table.columns if c not in columns], *[F.col(c).cast("double").alias(own[c]) for c in columns])
        day = F.col("target_date" if g.of_target else "origin_date") == F.col("__ds")
        if "__series_id" in table.columns:
            rows = rows.join(table, (F.col("series_id") == F.col("__series_id")) & day, "left").drop("__series_id", "__ds")
        else:  # a row for each day
            rows = rows.join(F.broadcast(table), day, "left").drop("__ds")
        made[name] = list(own.values())
    return rows, made


def exogenous(panel: DataFrame, block: list[str], train_end, top: int = 3, lags: tuple[int, ...] = (1, 5)) -> tuple[DataFrame, list[str]]:
    """``series_id, ds`` and lagged values of the ``top`` series of ``block`` that go most with each series, the series itself left out.

    Chosen by absolute correlation over the days up to ``train_end``, inside the
    fold, ties by name. Lags are steps of the other series and at least 1: what
    it has on the origin's own day isn't known there for sure. Raises for
    smaller lags and where no series of the block is there.
    """
    if any(k < 1 for k in lags):
        raise ValueError(f"lags of other series must be at least 1, not {sorted(lags)}")
    others = panel.where(F.col("series_id").isin(block)).select(F.col("series_id").alias("x"), "ds", "pos", F.col("y").alias("x_y"))
    if not others.head(1):
        raise ValueError(f"no series of the block {block} is in the panel")
    known = F.col("ds") <= F.lit(train_end)
    both = panel.where(known).select("series_id", "ds", "y").join(others.where(known).select("x", "ds", "x_y"), "ds").where("series_id <> x")
    order = Window.partitionBy("series_id").orderBy(F.abs("corr").desc_nulls_last(), "x")
    chosen = both.groupBy("series_id", "x").agg(correlation("y", "x_y").alias("corr")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    w = Window.partitionBy("x").orderBy("pos")
    lagged = others.select("x", "ds", F.struct(*[F.lag("x_y", k).over(w).alias(f"lag{k}") for k in lags]).alias("v"))
    # One row for each series and day again: the chosen ones are few, and summed up side by side.
    pairs = panel.select("series_id", "ds").join(chosen.select("series_id", "x", "place"), "series_id").join(lagged, ["x", "ds"])
    cells = {f"x{p}_lag{k}": F.max(F.when(F.col("place") == p, F.col(f"v.lag{k}"))) for p in range(1, top + 1) for k in lags}
    return pairs.groupBy("series_id", "ds").agg(*[c.alias(n) for n, c in cells.items()]), list(cells)


def ablation(panel: DataFrame, cal: DataFrame, folds: list[tuple], horizon: int, groups: list[str] | None = None, blocks: dict[str, list[str]] | None = None, model: str = "ridge", top: int = 3, lags: tuple[int, ...] = (1, 5)) -> DataFrame:
    """MAE of each fold with the plain features, with each group or exogenous block added to them, and with all groups: ``fold_id, added, n_features, n, mae, change_pct``.

    ``folds``: ``(fold_id, train_end, eval_start, eval_end)``. Everything that is
    chosen or fitted is so on the fold's training rows. A column without a value in them is left out.
    The rows with their groups and each fold's rows are stored once; every fit reads those.
    """
    groups, blocks = list(GROUPS) if groups is None else groups, blocks or {}
    panel = models.kept(panel)
    plain, names = models.supervised(panel, horizon)
    rows, made = with_groups(plain.where("label IS NOT NULL"), panel, cal, groups)
    rows, out = models.kept(rows), []
    for fold_id, train_end, start, end in folds:
        learnt, inside = models.parts_of(rows, train_end, start, end)
        both = rows.withColumns({"__train": learnt, "__scored": inside}).where("__train OR __scored")
        own = {"nothing": [], **made, **({"all groups": [c for g in groups for c in made[g]]} if len(groups) > 1 else {})}
        for name, block in blocks.items():
            table, columns = exogenous(panel, block, train_end, top, lags)
            table = table.select(F.col("series_id").alias("__s"), F.col("ds").alias("__d"), *[F.col(c).alias(f"{name}_{c}") for c in columns])
            at = (F.col("series_id") == F.col("__s")) & (F.col("origin_date") == F.col("__d"))
            both = both.join(table, at, "left").drop("__s", "__d")
            own[f"block {name}"] = [f"{name}_{c}" for c in columns]
        both = models.kept(both) if blocks else both
        train, scored = both.where("__train"), both.where("__scored")
        every = sorted({c for cols in own.values() for c in cols})
        there = train.agg(*[F.count(c).alias(c) for c in every]).first() if every else {}
        cases = {k: [*names, *[c for c in cols if there[c]]] for k, cols in own.items()}
        fitted = models.together([lambda cols=cols: models.pipeline(cols, models.estimators()[model]).fit(train) for cols in cases.values()])
        for (added, cols), f in zip(cases.items(), fitted):
            score = f.transform(scored).agg(F.count("*").alias("n"), F.avg(F.abs(F.col("y_true") - F.col("raw"))).alias("mae"))
            out.append(score.select(F.lit(fold_id).alias("fold_id"), F.lit(added).alias("added"), F.lit(len(cols)).alias("n_features"), "n", "mae"))
    result = reduce(DataFrame.unionByName, out)
    whole = F.max(F.when(F.col("added") == "nothing", F.col("mae"))).over(Window.partitionBy("fold_id"))
    return result.withColumn("change_pct", F.when(whole > 0, 100 * (F.col("mae") - whole) / whole))
