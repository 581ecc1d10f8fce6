"""Business calendar as DataFrames: movable and fixed holidays, shifted deadlines, distances.

A calendar has a row for each day, so its windows run over a few thousand rows
and need no partition key; panels join it by broadcast on the date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Public holidays as (month, day), days around Orthodox Easter, deadlines.
FIXED_HOLIDAYS = [(1, 1), (1, 2), (1, 7), (1, 19), (3, 3), (3, 8), (4, 9), (5, 9), (5, 12), (5, 26), (8, 28), (10, 14), (11, 23)]
AROUND_EASTER = [-2, -1, 0, 1]
MONTHLY_DEADLINE = 15
ANNUAL_DEADLINES = [(11, 1), (11, 15)]
DISTANCE_CAP = 10
PERIOD_CAPS = {"eom": ("month", 25), "eoq": ("quarter", 70), "eoy": ("year", 260)}


def orthodox_easter(year: Column) -> Column:
    """Gregorian date of Orthodox Easter for a year between 1900 and 2099."""
    d = (19 * (year % 19) + 16) % 30
    e = (2 * (year % 4) + 4 * (year % 7) + 6 * d) % 7
    return F.date_add(F.make_date(year, F.lit(4), F.lit(4)), (d + e - 1).cast("int"))


def years(spark: SparkSession, first: int, last: int) -> DataFrame:
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias("year"))


def holidays(spark: SparkSession, first: int, last: int, fixed=FIXED_HOLIDAYS, around=AROUND_EASTER) -> DataFrame:
    """``ds``: each holiday of the years once. The set is a parameter."""
    table = years(spark, first, last)
    fixed_days = F.array(*[F.make_date("year", F.lit(m), F.lit(d)) for m, d in fixed])
    moving = F.array(*[F.date_add(orthodox_easter(F.col("year")), k) for k in around])
    return table.select(F.explode(F.concat(fixed_days, moving)).alias("ds")).distinct()


def calendar(spark: SparkSession, first: int, last: int, holiday_table: DataFrame | None = None) -> DataFrame:
    """``ds, dow`` (Monday 0), ``is_weekend, is_holiday, is_bday, bpos`` (business days up to and including the day)."""
    days = years(spark, first, last).select(F.explode(F.sequence(F.make_date("year", F.lit(1), F.lit(1)), F.make_date("year", F.lit(12), F.lit(31)))).alias("ds"))
    marked = (holidays(spark, first, last) if holiday_table is None else holiday_table).select(F.col("ds"), F.lit(1).alias("is_holiday")).distinct()
    out = days.join(F.broadcast(marked), "ds", "left").withColumns({"dow": F.weekday("ds"), "is_holiday": F.coalesce("is_holiday", F.lit(0))})
    out = out.withColumn("is_weekend", (F.col("dow") >= 5).cast("int"))
    out = out.withColumn("is_bday", ((F.col("is_weekend") == 0) & (F.col("is_holiday") == 0)).cast("int"))
    return out.withColumn("bpos", F.sum("is_bday").over(Window.orderBy("ds")).cast("int")).select("ds", "dow", "is_weekend", "is_holiday", "is_bday", "bpos")


def next_business_day(cal: DataFrame) -> DataFrame:
    """``ds, shifted``: the day itself if it is a business day, else the next one; never an earlier one."""
    ahead = Window.orderBy("ds").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return cal.select("ds", F.first(F.when(F.col("is_bday") == 1, F.col("ds")), ignorenulls=True).over(ahead).alias("shifted"))


def deadlines(cal: DataFrame, monthly: int = MONTHLY_DEADLINE, annual=ANNUAL_DEADLINES) -> DataFrame:
    """``kind, nominal, ds`` of each obligation, moved forward to a business day."""
    shifted = next_business_day(cal)
    on_annual = None
    for m, d in annual:
        test = (F.month("ds") == m) & (F.dayofmonth("ds") == d)
        on_annual = test if on_annual is None else on_annual | test
    kinds = [shifted.where(F.dayofmonth("ds") == monthly).select(F.lit("monthly_15").alias("kind"), F.col("ds").alias("nominal"), F.col("shifted").alias("ds"))]
    if on_annual is not None:
        kinds.append(shifted.where(on_annual).select(F.lit("annual").alias("kind"), F.col("ds").alias("nominal"), F.col("shifted").alias("ds")))
    out = kinds[0] if len(kinds) == 1 else kinds[0].unionByName(kinds[1])
    return out.where("ds IS NOT NULL")


def _near(order: str, event: Column, position: Column, cap: int) -> tuple[Column, Column]:
    """Steps to the next event (itself included) and since the one before, both within 0 and ``cap``."""
    ahead = Window.orderBy(order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    nxt = F.first(F.when(event, position), ignorenulls=True).over(ahead)
    last = F.last(F.when(event, position), ignorenulls=True).over(before)
    return F.coalesce(F.least(nxt - position, F.lit(cap)), F.lit(cap)), F.coalesce(F.least(position - last, F.lit(cap)), F.lit(cap))


def deadline_features(cal: DataFrame, start: str, end: str) -> DataFrame:
    """Features of Monday-Friday days from ``start`` to ``end``: deadlines, distances in weekdays, how far this month's deadline moved."""
    due = deadlines(cal)
    dates = due.groupBy("ds").agg(F.max((F.col("kind") == "monthly_15").cast("int")).alias("m"), F.max((F.col("kind") == "annual").cast("int")).alias("a"))
    moved = due.where("kind = 'monthly_15'").select(F.trunc("nominal", "month").alias("month"), F.datediff("ds", "nominal").alias("deadline_shift_days"))
    days = cal.where((F.col("is_weekend") == 0) & F.col("ds").between(start, end)).select("ds")
    days = days.join(dates, "ds", "left").withColumns({"is_deadline_monthly": F.coalesce("m", F.lit(0)), "is_deadline_annual": F.coalesce("a", F.lit(0))})
    days = days.withColumn("p", F.row_number().over(Window.orderBy("ds")))
    to, since = _near("ds", F.col("is_deadline_monthly") == 1, F.col("p"), DISTANCE_CAP)
    days = days.withColumns({"bdays_to_deadline": to, "bdays_since_deadline": since, "is_deadline_any": F.greatest("is_deadline_monthly", "is_deadline_annual"), "month": F.trunc("ds", "month")})
    return days.join(moved, "month", "left").select("ds", "is_deadline_monthly", "is_deadline_annual", "is_deadline_any", "bdays_to_deadline", "bdays_since_deadline", "deadline_shift_days")


def holiday_features(cal: DataFrame, start: str, end: str) -> DataFrame:
    """Features of Monday-Friday days: holidays near (in days), bridge days, days from Easter within 10."""
    order = Window.orderBy("ds")
    whole = cal.withColumns({"prev_b": F.lag("is_bday").over(order), "next_b": F.lead("is_bday").over(order)})
    inside = whole.where(F.col("ds").between(start, end)).withColumn("n", F.datediff("ds", F.lit("1970-01-01")))
    to, since = _near("ds", F.col("is_holiday") == 1, F.col("n"), DISTANCE_CAP)
    from_easter = F.datediff("ds", orthodox_easter(F.year("ds")))
    out = inside.withColumns({"days_to_holiday": to, "days_since_holiday": since, "days_from_easter": F.greatest(F.lit(-10), F.least(F.lit(10), from_easter))})
    out = out.withColumns({"is_bridge_day": ((F.col("prev_b") == 0) & (F.col("next_b") == 0) & (F.col("is_bday") == 1)).cast("int"), "in_easter_week": (F.abs("days_from_easter") <= 3).cast("int")})
    return out.where("is_weekend = 0").select("ds", "is_holiday", "days_to_holiday", "days_since_holiday", "is_bridge_day", "days_from_easter", "in_easter_week")


def period_features(cal: DataFrame, start: str, end: str) -> DataFrame:
    """Features of Monday-Friday days: business days left in month, quarter and year of the true calendar, week of month, month, weekday."""
    out = cal
    for name, (unit, cap) in PERIOD_CAPS.items():
        last = F.max("bpos").over(Window.partitionBy(F.date_trunc(unit, "ds")))
        out = out.withColumn(f"bdays_to_{name}", F.when(F.col("is_bday") == 0, 0).otherwise(F.least(last - F.col("bpos"), F.lit(cap))))
    out = out.withColumns({"week_of_month": F.floor((F.dayofmonth("ds") - 1) / 7).cast("int") + 1, "month": F.month("ds")})
    return out.where((F.col("is_weekend") == 0) & F.col("ds").between(start, end)).select("ds", "bdays_to_eom", "bdays_to_eoq", "bdays_to_eoy", "week_of_month", "month", "dow")


def date_parts(days: DataFrame) -> DataFrame:
    """``ds`` with the parts that models use; month and quarter ends are those of business days."""
    nxt = F.date_add("ds", F.when(F.weekday("ds") == 4, 3).otherwise(1))
    return days.select(
        "ds", F.weekday("ds").alias("dow"), F.dayofyear("ds").alias("doy"), F.month("ds").alias("month"), F.dayofmonth("ds").alias("dom"), F.quarter("ds").alias("quarter"), F.weekofyear("ds").alias("week"),
        (F.month(nxt) != F.month("ds")).cast("int").alias("is_month_end"), (F.quarter(nxt) != F.quarter("ds")).cast("int").alias("is_quarter_end"),
    )


def month_position(cal: DataFrame) -> DataFrame:
    """``ds, bdom, bdom_rev`` of weekdays: place in the month and days left in it, on the true calendar."""
    month = Window.partitionBy(F.trunc("ds", "month"))
    days = cal.where("is_weekend = 0")
    n = F.row_number().over(month.orderBy("ds"))
    return days.select("ds", n.alias("bdom"), (F.count("*").over(month) - n).cast("int").alias("bdom_rev"))


def future_business_days(cal: DataFrame, origins: DataFrame, horizon: int, cadence: str = "daily") -> DataFrame:
    """``origin, step, ds``: the next dates after each origin: weekdays, Fridays or month ends."""
    steps = origins.select(F.col("ds").alias("origin")).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    if cadence == "weekly":
        return steps.withColumn("ds", F.date_add(F.next_day("origin", "FR"), (F.col("step") - 1) * 7))
    if cadence == "monthly":
        past = F.when(F.last_day("origin") == F.col("origin"), 0).otherwise(1)
        return steps.withColumn("ds", F.last_day(F.add_months(F.trunc("origin", "month"), F.col("step") - past)))
    # Full weeks first, then the days left, over the weekend if need be.
    dow = F.least(F.weekday("origin"), F.lit(4))
    left, at = F.col("step") % 5, F.when(F.weekday("origin") > 4, F.date_sub("origin", F.weekday("origin") - 4)).otherwise(F.col("origin"))
    return steps.withColumn("ds", F.date_add(at, (F.floor(F.col("step") / 5) * 7 + left + F.when(dow + left > 4, 2).otherwise(0)).cast("int")))
