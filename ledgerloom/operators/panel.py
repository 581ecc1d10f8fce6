"""Panels: many series in one long table ``series_id, ds, y``. Windows are partitioned by series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names of stock series; everything else is a flow. The one definition used everywhere.
LEVEL_PATTERN = r"balance|stock|level|cash_on_hand"


def by_series(order: str = "pos", *more: str):
    return Window.partitionBy("series_id", *more).orderBy(order)


def classify_kind(name: str | Column) -> Column:
    """``level`` or ``flow`` from a metric's name."""
    return F.when(F.lower(name).rlike(LEVEL_PATTERN), "level").otherwise("flow")


def finite(column: str | Column) -> Column:
    """Null where a number isn't finite."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def sum_duplicates(rows: DataFrame) -> DataFrame:
    """One value for each series and day; all null stays null."""
    return rows.groupBy("series_id", "ds").agg(F.sum("y").alias("y"))


def one_per_date(rows: DataFrame, tie: str, keep: str = "first") -> DataFrame:
    """Drop undated rows; of several rows of a day keep the first or last by ``tie``."""
    order = F.col(tie).asc() if keep == "first" else F.col(tie).desc()
    n = F.row_number().over(Window.partitionBy("series_id", "ds").orderBy(order))
    return rows.where("ds IS NOT NULL").withColumn("__n", n).where("__n = 1").drop("__n")


def spine(panel: DataFrame, weekdays: bool) -> DataFrame:
    """Every day (or weekday) from a series' first to its last."""
    ends = panel.groupBy("series_id").agg(F.min("ds").alias("a"), F.max("ds").alias("b"))
    days = ends.select("series_id", F.explode(F.sequence("a", "b")).alias("ds"))
    return days.where(F.weekday("ds") < 5) if weekdays else days


def daily_reindex(panel: DataFrame) -> DataFrame:
    """Series on all days; a day that wasn't reported has a null value and ``is_reported`` false."""
    seen = panel.withColumn("is_reported", F.lit(True))
    return spine(panel, False).join(seen, ["series_id", "ds"], "left").withColumn("is_reported", F.coalesce("is_reported", F.lit(False)))


def fill_forward(column: str = "y", order: str = "ds") -> Column:
    return F.last(column, ignorenulls=True).over(by_series(order).rowsBetween(Window.unboundedPreceding, 0))


def business_index(panel: DataFrame, kind: str = "flow") -> DataFrame:
    """Series on Monday-Friday with the ordinal ``pos``: absent flows are 0, absent levels are carried forward."""
    rows = spine(panel, True).join(panel, ["series_id", "ds"], "left")
    value = F.coalesce("y", F.lit(0.0)) if kind == "flow" else fill_forward()
    return rows.select("series_id", "ds", (F.row_number().over(by_series("ds")) - 1).alias("pos"), F.col("y").isNotNull().alias("is_reported"), value.alias("y"))


def horizon_target(panel: DataFrame, horizon: int, delta: bool = False) -> DataFrame:
    """Value ``horizon`` steps on, by position; with ``delta`` its change from the origin."""
    ahead = F.lead("y", horizon).over(by_series())
    return panel.withColumns({"target": ahead - F.col("y") if delta else ahead, "target_date": F.lead("ds", horizon).over(by_series())})


def last_months(panel: DataFrame, months: int) -> DataFrame:
    """Rows of the last months before each series' end."""
    end = F.max("ds").over(Window.partitionBy("series_id"))
    return panel.withColumn("__from", F.add_months(end, -months)).where(F.col("ds") >= F.col("__from")).drop("__from")


def correlation(a: str, b: str) -> Column:
    """Of two columns over the rows that hold both; null where one doesn't vary, which the built-in takes for an error."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def suspicious_zeros(panel: DataFrame, last: int = 10, level: bool = False) -> DataFrame:
    """Zeros among a series' last points become null: those of a level always, those of a flow if its median is above zero."""
    rank = F.row_number().over(Window.partitionBy("series_id").orderBy(F.col("pos").desc()))
    usual = panel.groupBy("series_id").agg(F.median("y").alias("__usual"))
    out = panel.withColumn("__r", rank).join(usual, "series_id")
    return out.withColumn("y", F.when((F.col("__r") <= last) & (F.col("y") == 0) & (F.lit(level) | (F.col("__usual") > 0)), None).otherwise(F.col("y"))).drop("__r", "__usual")


def running_balance(panel: DataFrame, order: str = "ds") -> DataFrame:
    """A stock from a flow."""
    return panel.withColumn("y", F.sum("y").over(by_series(order).rowsBetween(Window.unboundedPreceding, 0)))


def first_difference(panel: DataFrame, order: str = "ds") -> DataFrame:
    return panel.withColumn("diff", F.col("y") - F.lag("y").over(by_series(order)))


def coverage_gaps(panel: DataFrame, cal: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Business days of the calendar that a series should have reported and didn't, less those on the allow-list."""
    want = spine(panel, True).join(F.broadcast(cal.where("is_holiday = 1").select("ds")), "ds", "left_anti")
    gaps = want.join(panel.where("y IS NOT NULL").select("series_id", "ds"), ["series_id", "ds"], "left_anti")
    return gaps if allowed is None else gaps.join(allowed, "ds", "left_anti")


def holiday_flag(panel: DataFrame, holiday_table: DataFrame) -> DataFrame:
    marked = holiday_table.select("ds").distinct().withColumn("is_holiday", F.lit(1))
    return panel.join(F.broadcast(marked), "ds", "left").withColumn("is_holiday", F.coalesce("is_holiday", F.lit(0)))


def bucket_end(cadence: str, ds: str = "ds") -> Column:
    """The Friday that ends a day's week (Saturday to Friday), or its month's last day."""
    return F.next_day(F.date_sub(ds, 1), "FR") if cadence == "weekly" else F.last_day(ds)


def resample(panel: DataFrame, cadence: str = "weekly", kind: str = "flow") -> DataFrame:
    """Weeks to Friday or months: flows are summed (an empty bucket is 0), levels keep their last known value (null if there is none)."""
    rows = panel.withColumn("bucket", bucket_end(cadence))
    value = F.sum("y") if kind == "flow" else F.max_by("y", F.when(F.col("y").isNotNull(), F.col("ds")))
    found = rows.groupBy("series_id", "bucket").agg(value.alias("y"))
    span = found.groupBy("series_id").agg(F.min("bucket").alias("a"), F.max("bucket").alias("b"))
    step = F.expr("INTERVAL 7 DAYS") if cadence == "weekly" else F.expr("INTERVAL 1 MONTH")
    # Months are counted from their first day, as last days differ in number.
    every = span.select("series_id", F.explode(F.sequence("a", "b", step)).alias("bucket")) if cadence == "weekly" else span.select("series_id", F.explode(F.sequence(F.trunc("a", "month"), F.trunc("b", "month"), step)).alias("m")).select("series_id", F.last_day("m").alias("bucket"))
    out = every.join(found, ["series_id", "bucket"], "left")
    return out.withColumn("y", F.coalesce("y", F.lit(0.0))) if kind == "flow" else out


def in_window(ds: str, windows: list[tuple[str, str, str]]) -> Column:
    """Name of the (name, first, last) window that a date lies in."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, a, b in windows:
        out = out.when(F.col(ds).between(F.lit(a).cast("date"), F.lit(b).cast("date")), name)
    return out


def assert_within(rows: DataFrame, first: str, last: str, context: str, ds: str = "ds") -> None:
    """Raise if a date lies outside."""
    bad = rows.where(~F.col(ds).between(F.lit(first).cast("date"), F.lit(last).cast("date"))).select(ds).head(1)
    if bad:
        raise ValueError(f"{context}: {bad[0][0]} lies outside {first} to {last}")


def drop_baselines(rows: DataFrame, pattern: str = "(?i)naive|persist|baseline|ops") -> DataFrame:
    return rows.where(~F.col("model").rlike(pattern))


def event_distance(panel: DataFrame, event: Column, cap: int) -> DataFrame:
    """Steps to the next event and since the last one along a series, capped."""
    at = F.when(event, F.col("pos"))
    nxt = F.first(at, ignorenulls=True).over(by_series().rowsBetween(0, Window.unboundedFollowing))
    last = F.last(at, ignorenulls=True).over(by_series().rowsBetween(Window.unboundedPreceding, -1))
    return panel.withColumns({"to_next": F.coalesce(F.least(nxt - F.col("pos"), F.lit(cap)), F.lit(cap)), "since": F.coalesce(F.least(F.col("pos") - last, F.lit(cap)), F.lit(cap))})


def normalise_ledger(rows: DataFrame) -> DataFrame:
    """A ledger with any of inflow, outflow, net_flow and balance columns to ``series_id, ds, net_flow``, on all days."""
    rows = rows.toDF(*[c.strip().lower() for c in rows.columns])
    have = set(rows.columns)
    options = [F.col("net_flow")] if "net_flow" in have else []
    if {"inflow", "outflow"} <= have:
        options.append(F.col("inflow") - F.col("outflow"))
    if "balance" in have:
        options.append(F.col("balance") - F.lag("balance").over(by_series("ds")))
    flow = rows.select("series_id", "ds", F.coalesce(*options).alias("y"))
    return daily_reindex(sum_duplicates(flow)).select("series_id", "ds", F.col("y").alias("net_flow"))
