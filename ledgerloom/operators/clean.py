"""Causal cleaning of reported panels: nothing after a row changes it."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .panel import by_series, daily_reindex, fill_forward


def causal_impute(panel: DataFrame, weeks: int = 8) -> DataFrame:
    """Missing business-day values as the median of the last ``weeks`` observed ones of the same weekday, strictly earlier.

    ``panel``: ``series_id, ds, y, is_bday``. Imputed values never enter a
    median; with none observed yet the value stays null; other days stay as
    they are. Observed values are numbered within (series, weekday), a missing
    row takes the last number before it, and windows by that number give the
    medians, so the work is linear in the rows.
    """
    rows = panel.withColumns({"__dow": F.weekday("ds"), "__seen": (F.col("y").isNotNull() & (F.col("is_bday") == 1)).cast("int")})
    lane = Window.partitionBy("series_id", "__dow").orderBy("ds")
    rows = rows.withColumn("__k", F.coalesce(F.sum("__seen").over(lane.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    seen = rows.where("__seen = 1")
    by_number = Window.partitionBy("series_id", "__dow").orderBy("__k").rowsBetween(-(weeks - 1), 0)
    medians = seen.select("series_id", "__dow", "__k", F.percentile("y", F.lit(0.5)).over(by_number).alias("__median"))
    out = rows.join(medians, ["series_id", "__dow", "__k"], "left")
    fill = (F.col("__seen") == 0) & (F.col("is_bday") == 1)
    return out.withColumns({"imputed": fill & F.col("__median").isNotNull(), "clean": F.when(fill, F.col("__median")).otherwise(F.col("y"))}).drop("__dow", "__seen", "__k", "__median")


def validity_report(panel: DataFrame, cal: DataFrame, factor: float = 10.0, examples: int = 20) -> DataFrame:
    """Per series, over business days: negatives, and values above ``factor`` times the largest absolute value before, with the first of each: dates, and date, value, prior maximum and ratio."""
    rows = panel.where("y IS NOT NULL").join(F.broadcast(cal.where("is_bday = 1").select("ds")), "ds")
    before = F.max(F.abs("y")).over(by_series("ds").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("before", before).withColumns({"neg": F.col("y") < 0, "jump": F.coalesce((F.col("before") > 0) & (F.col("y") > factor * F.col("before")), F.lit(False))})
    # The first few of each are found by their place, so that no series' examples are gathered.
    place = lambda c: F.when(F.col(c), F.sum(F.col(c).cast("int")).over(by_series("ds")))
    rows = rows.withColumns({"n_neg": place("neg"), "n_jump": place("jump")})
    first = lambda n, what: F.sort_array(F.collect_list(F.when(F.col(n) <= examples, what)))
    jump = F.struct(F.col("ds").alias("date"), F.col("y").alias("value"), F.col("before").alias("prior_max"), (F.col("y") / F.col("before")).alias("ratio"))
    return rows.groupBy("series_id").agg(F.count_if("neg").alias("n_negative"), first("n_neg", F.col("ds")).alias("negative_dates"), F.count_if("jump").alias("n_jumps"), first("n_jump", jump).alias("jumps"))


def clip_mad(panel: DataFrame, k: float = 6.0) -> DataFrame:
    """Values clipped to ``k`` scaled median absolute deviations around the median, or to the 99th percentile of absolute values where that deviation is 0 (an explicit option: it looks at the whole series)."""
    middle = panel.groupBy("series_id").agg(F.median("y").alias("med"), F.percentile(F.abs("y"), F.lit(0.99)).alias("p99"))
    rows = panel.join(middle, "series_id")
    spread = rows.groupBy("series_id").agg(F.median(F.abs(F.col("y") - F.col("med"))).alias("mad"))
    rows = rows.join(spread, "series_id")
    limit = F.lit(1.4826 * k) * F.col("mad")
    low, high = F.when(F.col("mad") > 0, F.col("med") - limit).otherwise(-F.col("p99")), F.when(F.col("mad") > 0, F.col("med") + limit).otherwise(F.col("p99"))
    return rows.withColumn("clipped", F.greatest(F.least("y", high), low)).drop("med", "p99", "mad")


def variants(panel: DataFrame, cal: DataFrame, kind: str = "flow") -> DataFrame:
    """The three cleaning variants, long: ``variant, series_id, ds, y, is_reported``.

    ``raw``: all days, a blank of a flow on a business day stays blank, other
    days 0. ``conservative``: levels carried forward, flows 0 where blank.
    ``treasury``: flows imputed causally on business days.
    """
    rows = daily_reindex(panel).join(F.broadcast(cal.select("ds", "is_bday")), "ds")
    if kind == "level":
        filled = rows.withColumn("y", fill_forward())
        parts = [("raw", rows), ("conservative", filled), ("treasury", filled)]
    else:
        raw = rows.withColumn("y", F.when(F.col("is_bday") == 1, F.col("y")).otherwise(F.coalesce("y", F.lit(0.0))))
        treasury = causal_impute(raw)
        parts = [("raw", raw), ("conservative", rows.withColumn("y", F.coalesce("y", F.lit(0.0)))), ("treasury", treasury.withColumn("y", F.col("clean")))]
    out = None
    for name, part in parts:
        own = part.select(F.lit(name).alias("variant"), "series_id", "ds", "y", "is_reported")
        out = own if out is None else out.unionByName(own)
    return out


def coverage_counters(panel: DataFrame) -> DataFrame:
    """Rows, reported rows, blanks, zeros and the share reported, for each series."""
    return panel.groupBy("series_id").agg(
        F.count("*").alias("n_rows"), F.count_if("is_reported").alias("n_reported"), F.count_if(F.col("is_reported") & F.col("y").isNull()).alias("n_blank"), F.count_if(F.col("y") == 0).alias("n_zero"),
        (F.count_if("is_reported") / F.count("*")).alias("coverage"),
    )


# Days that the movable feast makes holidays, and days near it that aren't.
HOLIDAYS_KNOWN = ["2024-05-03", "2024-05-04", "2024-05-05", "2024-05-06", "2025-04-18", "2025-04-19", "2025-04-20", "2025-04-21", "2024-01-01", "2025-01-01"]
WORKDAYS_KNOWN = ["2024-04-16", "2024-04-17", "2024-04-18", "2024-04-19"]


@dataclasses.dataclass(frozen=True)
class Rule:
    """``violated`` must hold of ``allowed`` rows at most (of days, if ``by_day``) among those in ``scope``; both are SQL over ``series_id, ds, y, is_weekend, is_holiday, gap`` (days since the row before)."""

    name: str
    violated: str
    scope: str = "true"
    allowed: int = 0
    by_day: bool = False


def rules(holidays: list[str] | None = None, workdays: list[str] | None = None, missing_allowed: int = 0) -> list[Rule]:
    """The rules that cleaned panels are held to; known days outside the panel say nothing."""
    listed = lambda days: "ds IN (" + ", ".join(f"DATE '{d}'" for d in days) + ")" if days else "false"
    business = "is_weekend = 0 AND is_holiday = 0"
    return [
        Rule("daily_continuity", "gap > 1"),
        Rule("repeated_days", "gap = 0"),
        Rule("weekend_flag", "is_weekend IS NULL OR (weekday(ds) >= 5) <> (is_weekend = 1)"),
        Rule("holiday_flag", "is_holiday IS NULL OR is_holiday NOT IN (0, 1)"),
        Rule("known_holidays", "coalesce(is_holiday, -1) <> 1", listed(HOLIDAYS_KNOWN if holidays is None else holidays)),
        Rule("known_workdays", "coalesce(is_holiday, -1) <> 0", listed(WORKDAYS_KNOWN if workdays is None else workdays)),
        Rule("missing_business_days", "y IS NULL", business, missing_allowed, by_day=True),
        Rule("nonzero_other_days", "y <> 0", f"NOT ({business})"),
    ]


def assertions(rows: DataFrame, table: list[Rule] | None = None) -> DataFrame:
    """``rule, violations, allowed, holds`` for each rule, by one aggregate over ``series_id, ds, y, is_weekend, is_holiday``."""
    table = rules() if table is None else table
    rows = rows.withColumn("gap", F.datediff("ds", F.lag("ds").over(by_series("ds"))))
    broken = {r.name: F.expr(f"({r.scope}) AND ({r.violated})") for r in table}
    counts = rows.agg(*[(F.count_distinct(F.when(broken[r.name], F.col("ds"))) if r.by_day else F.count_if(broken[r.name])).alias(r.name) for r in table])
    allowed = F.create_map(*[x for r in table for x in (F.lit(r.name), F.lit(r.allowed))])
    long = counts.unpivot([], [r.name for r in table], "rule", "violations").withColumn("allowed", allowed[F.col("rule")])
    return long.withColumn("holds", F.col("violations") <= F.col("allowed"))


def compare(a: DataFrame, b: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Per series over the days that both have: rows, largest and mean difference, differences beyond the tolerance."""
    both = a.select("series_id", "ds", F.col("y").alias("__a")).join(b.select("series_id", "ds", F.col("y").alias("__b")), ["series_id", "ds"], "full")
    d = F.abs(F.col("__a") - F.col("__b"))
    return both.groupBy("series_id").agg(
        F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("n_common"), F.count_if(F.col("__a").isNull() != F.col("__b").isNull()).alias("n_one_side"), F.max(d).alias("max_diff"), F.avg(d).alias("mean_diff"),
        F.count_if(d > tolerance).alias("n_diff"),
    )
