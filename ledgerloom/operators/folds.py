"""Folds and windows as small tables that panels join by date or position."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def yearly_folds(panel: DataFrame, min_train_years: int = 4, last: int | None = None, eval_start: str | None = None, eval_end: str | None = None) -> DataFrame:
    """``series_id, fold_id, train_end, eval_start, eval_end``: each year with enough years before it, trimmed to the window."""
    spans = panel.groupBy("series_id", F.year("ds").alias("year")).agg(F.min("ds").alias("a"), F.max("ds").alias("b"))
    order = Window.partitionBy("series_id").orderBy("year")
    out = spans.withColumns({"n": F.row_number().over(order), "train_end": F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))}).where(F.col("n") > min_train_years)
    start = F.greatest("a", F.lit(eval_start).cast("date")) if eval_start else F.col("a")
    end = F.least("b", F.lit(eval_end).cast("date")) if eval_end else F.col("b")
    out = out.select("series_id", F.col("year").alias("fold_id"), "train_end", start.alias("eval_start"), end.alias("eval_end")).where("eval_start <= eval_end")
    if last is not None:
        recent = F.row_number().over(Window.partitionBy("series_id").orderBy(F.col("fold_id").desc()))
        out = out.withColumn("__r", recent).where(F.col("__r") <= last).drop("__r")
    return out


def tiled_blocks(panel: DataFrame, horizon: int, start: str) -> DataFrame:
    """Blocks of ``horizon`` positions from the first row at or after ``start``."""
    first = panel.where(F.col("ds") >= F.lit(start).cast("date")).groupBy("series_id").agg(F.min("pos").alias("p0"))
    rows = panel.join(first, "series_id").where(F.col("pos") >= F.col("p0"))
    rows = rows.withColumn("block", F.floor((F.col("pos") - F.col("p0")) / horizon).cast("int"))
    return rows.groupBy("series_id", "block").agg(F.min("ds").alias("first_day"), F.max("ds").alias("last_day"), F.count("*").alias("n"))


def embargoed_folds(panel: DataFrame, horizon: int, n: int = 5, min_train: int = 1008, block: int = 126) -> DataFrame:
    """The last ``n`` blocks of positions, each with training rows up to ``horizon`` before it: ``fold_id, train_end_pos, eval_start_pos, eval_end_pos``."""
    size = panel.groupBy("series_id").agg((F.max("pos") + 1).alias("size"))
    out = size.withColumn("fold_id", F.explode(F.sequence(F.lit(1), F.lit(n))))
    start = F.col("size") - (n + 1 - F.col("fold_id")) * block
    out = out.select("series_id", "fold_id", (start - horizon - 1).alias("train_end_pos"), start.alias("eval_start_pos"), (start + block - 1).alias("eval_end_pos"))
    return out.where(F.col("train_end_pos") + 1 >= min_train)


def last_window(panel: DataFrame, horizon: int) -> DataFrame:
    """The fold for short series: the last ``max(h, min(12, n / 4))`` rows."""
    size = panel.groupBy("series_id").agg((F.max("pos") + 1).alias("size"))
    width = F.greatest(F.lit(horizon), F.least(F.lit(12), F.floor(F.col("size") / 4))).cast("int")
    return size.select("series_id", (F.col("size") - width - 1).cast("int").alias("train_end_pos"), (F.col("size") - width).cast("int").alias("eval_start_pos"), (F.col("size") - 1).cast("int").alias("eval_end_pos"))


def fold_rows(rows: DataFrame, folds: DataFrame, date: str = "ds") -> DataFrame:
    """Each row with the folds whose evaluation range holds its date: an equi-join on the series with a range on top."""
    f = folds.select(F.col("series_id").alias("__s"), "fold_id", "train_end", "eval_start", "eval_end")
    return rows.join(f, (F.col("series_id") == F.col("__s")) & F.col(date).between(F.col("eval_start"), F.col("eval_end"))).drop("__s")


def tail_splits(panel: DataFrame, validation: float = 0.1, calibration: float = 0.1) -> DataFrame:
    """``part``: fit, validation or calibration, by place in time."""
    rank = F.percent_rank().over(Window.partitionBy("series_id").orderBy("pos"))
    part = F.when(rank >= 1 - calibration, "calibration").when(rank >= 1 - calibration - validation, "validation").otherwise("fit")
    return panel.withColumn("part", part)


def blocks_from_end(panel: DataFrame, horizon: int, folds: int | None = None, min_train_years: int = 4) -> DataFrame:
    """Blocks of ``horizon`` positions counted back from each series' end, the last ``folds`` of them (None: all), numbered from the earliest: ``fold_id, train_end_pos, eval_start_pos, eval_end_pos``.

    A block needs more than ``max(252 * min_train_years, horizon, 30)`` rows before it.
    """
    least = max(252 * min_train_years, horizon, 30)
    size = panel.groupBy("series_id").agg((F.max("pos") + 1).alias("size"))
    fit = F.greatest(F.floor((F.col("size") - least - 1) / horizon), F.lit(0)).cast("int")
    n = fit if folds is None else F.least(fit, F.lit(folds))
    out = size.withColumn("n", n).where("n > 0").withColumn("fold_id", F.explode(F.sequence(F.lit(1), F.col("n"))))
    start = F.col("size") - (F.col("n") + 1 - F.col("fold_id")) * horizon
    return out.select("series_id", "fold_id", (start - 1).cast("int").alias("train_end_pos"), start.cast("int").alias("eval_start_pos"), (start + horizon - 1).cast("int").alias("eval_end_pos"))


#: Horizons, sequence lengths, lags and windows by cadence.
RECIPES = {
    "daily": {"horizons": [1, 5, 20], "lookback": 64, "lags": [1, 3, 7, 14], "windows": [3, 7, 14]},
    "weekly": {"horizons": [1, 4, 12], "lookback": 52, "lags": [1, 4, 12], "windows": [4, 8, 12]},
    "monthly": {"horizons": [1, 3, 6], "lookback": 36, "lags": [1, 12], "windows": [3, 6, 12]},
}


def recipe_targets(panel: DataFrame, cadence: str) -> DataFrame:
    """``series_id, cadence, horizon, lookback, n``: origins of a panel at this cadence that have a whole sequence before them and a target, by horizon of the recipe."""
    own = RECIPES[cadence]
    size = panel.groupBy("series_id").agg((F.max("pos") + 1).alias("size"))
    out = size.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in own["horizons"]])))
    n = F.greatest(F.lit(0), F.col("size") - own["lookback"] + 1 - F.col("horizon")).cast("long")
    return out.select("series_id", F.lit(cadence).alias("cadence"), "horizon", F.lit(own["lookback"]).alias("lookback"), n.alias("n"))
