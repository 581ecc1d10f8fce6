"""Backward-only features of a panel on positions. Every frame ends at or before the origin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .panel import by_series, correlation


def lags(panel: DataFrame, steps: list[int]) -> DataFrame:
    return panel.withColumns({f"lag_{k}": F.lag("y", k).over(by_series()) for k in steps})


def trailing(panel: DataFrame, windows: list[int]) -> DataFrame:
    """Mean and population standard deviation of windows that end yesterday."""
    out = {}
    for w in windows:
        frame = by_series().rowsBetween(-w, -1)
        out |= {f"mean_{w}": F.avg("y").over(frame), f"std_{w}": F.stddev_pop("y").over(frame)}
    return panel.withColumns(out)


def robust_trailing(panel: DataFrame, windows: tuple[int, ...] = (5, 21, 63)) -> DataFrame:
    """Median, maximum and 90th percentile of windows that end yesterday, given ``max(2, w // 3)`` values."""
    out = {}
    for w in windows:
        frame = by_series().rowsBetween(-w, -1)
        enough = F.count("y").over(frame) >= max(2, w // 3)
        for name, value in (("med", F.percentile("y", F.lit(0.5)).over(frame)), ("max", F.max("y").over(frame)), ("q90", F.percentile("y", F.lit(0.9)).over(frame))):
            out[f"{name}_{w}"] = F.when(enough, value)
    return panel.withColumns(out)


def ewma(panel: DataFrame, half_lives: tuple[int, ...] = (5, 21)) -> DataFrame:
    """Exponentially weighted mean of all values up to yesterday, weights normalised, null values with weight 0; null before two values.

    Positions are cut into blocks of a hundred half-lives. Within a block
    weights that grow by position are summed as the window goes, and what
    earlier blocks add is carried over as one number for each block.
    """
    out, past = panel, by_series().rowsBetween(Window.unboundedPreceding, -1)
    for h in half_lives:
        up = F.when(F.col("y").isNotNull(), F.pow(F.lit(2.0), (F.col("pos") - F.col("__b") * (100 * h)) / h))
        rows = out.withColumn("__b", F.floor(F.col("pos") / (100 * h)))
        ends = rows.groupBy("series_id", "__b").agg(F.coalesce(F.sum(up * F.col("y")), F.lit(0.0)).alias("v"), F.coalesce(F.sum(up), F.lit(0.0)).alias("w"))
        earlier = F.collect_list(F.struct("__b", "v", "w")).over(Window.partitionBy("series_id").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
        carry = [F.expr(f"aggregate(__e, 0D, (a, x) -> a + x.{c} * pow(2D, -100D * (__b - x.__b)))").alias(f"__{c}") for c in "vw"]
        carried = ends.withColumn("__e", earlier).select("series_id", "__b", *carry)
        inside = Window.partitionBy("series_id", "__b").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
        sums = [F.coalesce(F.sum(x).over(inside), F.lit(0.0)) for x in (up * F.col("y"), up)]
        rows = rows.withColumns({"__n": F.count("y").over(past), "__sv": sums[0], "__sw": sums[1]}).join(carried, ["series_id", "__b"])
        out = rows.withColumn(f"ewm_{h}", F.when(F.col("__n") >= 2, (F.col("__sv") + F.col("__v")) / (F.col("__sw") + F.col("__w")))).select(*out.columns, f"ewm_{h}")
    return out


def weekday_dummies(column: str = "dow") -> dict[str, Column]:
    """Tuesday to Friday as 0/1 columns; Monday is the base."""
    return {f"dow_{k}": (F.col(column) == k).cast("int") for k in range(1, 5)}


def weekday_rolling(panel: DataFrame, n: int = 8) -> DataFrame:
    """Mean of the last ``n`` rows of the same weekday."""
    frame = by_series("pos", "dow").rowsBetween(-(n - 1), 0)
    return panel.withColumn("dow", F.weekday("ds")).withColumn("dow_mean", F.avg("y").over(frame))


def z_scores(panel: DataFrame, window: int = 60, least: int = 20, limit: float = 4.0) -> DataFrame:
    """Rolling z-score and whether it is beyond the limit."""
    frame = by_series().rowsBetween(-(window - 1), 0)
    sd = F.stddev_samp("y").over(frame)
    z = F.when((F.count("y").over(frame) >= least) & (sd > 0), (F.col("y") - F.avg("y").over(frame)) / sd)
    return panel.withColumn("z", z).withColumn("is_outlier", F.coalesce(F.abs("z") > limit, F.lit(False)))


def aligned_lags(panel: DataFrame, month_place: DataFrame) -> DataFrame:
    """Value at the same business day of last month and of the same month last year, one row earlier for safety.

    ``month_place``: ``ds, bdom`` of the true calendar. An equi-join on the
    shifted month and the place in it; only earlier rows count.
    """
    rows = panel.join(F.broadcast(month_place.select("ds", "bdom")), "ds").withColumn("m", F.year("ds") * 12 + F.month("ds"))
    rows = rows.withColumn("safe", F.lag("y").over(by_series()))
    for name, back in (("prev_month", 1), ("prev_year", 12)):
        old = rows.select("series_id", (F.col("m") + back).alias("m"), "bdom", F.col("pos").alias("__pos"), F.col("safe").alias("__v"))
        rows = rows.join(old, ["series_id", "m", "bdom"], "left").withColumn(f"y_{name}", F.when(F.col("__pos") < F.col("pos"), F.col("__v"))).drop("__pos", "__v")
    return rows.drop("m", "safe")


def exogenous_ranking(panel: DataFrame, target: str, top: int) -> DataFrame:
    """Series most correlated with ``target`` by absolute value, over the rows given (select inside a fold)."""
    aim = panel.where(F.col("series_id") == target).select("ds", F.col("y").alias("t"))
    both = panel.where(F.col("series_id") != target).join(aim, "ds")
    out = both.groupBy("series_id").agg(correlation("y", "t").alias("corr"))
    place = F.row_number().over(Window.orderBy(F.abs("corr").desc_nulls_last(), "series_id"))
    return out.withColumn("rank", place).where(F.col("rank") <= top)


def sequences(panel: DataFrame, length: int, horizon: int, level: bool = False) -> DataFrame:
    """Arrays of the last ``length`` values (oldest first) with the value ``horizon`` steps on; for levels changes from the origin."""
    frame = by_series().rowsBetween(-(length - 1), 0)
    out = panel.withColumns({"window": F.collect_list("y").over(frame), "target": F.lead("y", horizon).over(by_series())})
    out = out.where((F.size("window") == length) & F.col("target").isNotNull())
    if level:
        out = out.withColumns({"window": F.expr("transform(window, v -> v - y)"), "target": F.col("target") - F.col("y")})
    return out


def log_standardise(panel: DataFrame, fit: Column) -> DataFrame:
    """``log1p`` of the value, at least 0, standardised by mean and population deviation of the rows where ``fit`` holds; with its inverse."""
    z = F.log1p(F.greatest("y", F.lit(0.0)))
    stats = panel.where(fit).groupBy("series_id").agg(F.avg(z).alias("mu"), F.stddev_pop(z).alias("sd")).withColumn("sd", F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0))
    out = panel.join(stats, "series_id").withColumn("z", (z - F.col("mu")) / F.col("sd"))
    return out.withColumn("back", F.expm1(F.col("z") * F.col("sd") + F.col("mu")))


def safe_divide(a: str, b: str, eps: float = 1e-9) -> Column:
    return F.col(a) / F.greatest(F.abs(b), F.lit(eps))


def name_slug(column: str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(column)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def feature_set_hash(names: DataFrame) -> DataFrame:
    """SHA-256 of a group's sorted names: ``group, hash``."""
    return names.groupBy("group").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("name")), "\n"), 256).alias("hash"))


def unpivot_features(rows: DataFrame, names: list[str]) -> DataFrame:
    """``series_id, pos, feature, value`` of numeric columns."""
    return rows.unpivot(["series_id", "pos"], names, "feature", "value")

