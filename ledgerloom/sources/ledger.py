"""Readers of ledgers: wide files with dates as columns, long files, tables whose date and value columns must be found."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.panel import bucket_end

# Names under which dates and values are found, exact first, then contained.
DATE_NAMES = ["date", "ds", "day", "orderdate", "shipdate", "timestamp", "ts", "datum", "fecha", "дата"]
VALUE_NAMES = ["balance", "value", "amount", "price", "y", "betrag", "importe", "сумма"]
#: Names of columns that tell rows or other tables' rows apart.
KEY_PATTERN = r"(key|(^|_)id)$"


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """CSV (with a header) or Parquet, by extension."""
    return spark.read.csv(path, header=True) if re.search(r"\.csv(\.gz)?/?$", path.lower()) else spark.read.parquet(path)


def wide_to_long(wide: DataFrame, name: str, pattern: str = "yyyy-MM-dd") -> DataFrame:
    """Dates as columns, metrics as rows, to ``series_id, ds, y``; columns that aren't dates are left out."""
    days = [c for c in wide.columns if c != name]
    rows = wide.select(F.col(name).alias("series_id"), *[F.col(f"`{c}`").cast("string").alias(c) for c in days]).unpivot("series_id", days, "day", "value")
    return rows.select("series_id", F.to_date(F.try_to_timestamp("day", F.lit(pattern))).alias("ds"), F.expr("try_cast(value AS double)").alias("y")).where("ds IS NOT NULL")


def union_years(*parts: DataFrame) -> DataFrame:
    """Several sheets or years, whatever columns each has."""
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def coerce(rows: DataFrame, date: str, values: list[str]) -> DataFrame:
    """Date and value columns from text; rows without a date go, values that aren't numbers become null."""
    out = rows.withColumn("ds", F.to_date(F.expr(f"try_cast(`{date}` AS timestamp)")))
    return out.select("ds", *[F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in values]).where("ds IS NOT NULL")


def date_shares(rows: DataFrame, order: str) -> DataFrame:
    """Of each column: share that reads as a date, share of steps in file order that don't go back, and their score.

    Rows are dealt out by ranges of ``order``; steps are counted within ranges,
    then between the last row of a range and the first of the next (a row for
    each range).
    """
    columns = [c for c in rows.columns if c != order]
    at = {c: F.expr(f"try_cast(cast(`{c}` AS string) AS timestamp)") for c in columns}
    # Bare numbers aren't dates, though a year would read as one.
    at = {c: F.when(~F.col(f"`{c}`").cast("string").rlike(r"^[-+]?[0-9.]+$"), t) for c, t in at.items()}
    parsed = rows.select(F.col(order).alias("__o"), *[t.alias(c) for c, t in at.items()]).repartitionByRange("__o").withColumn("__range", F.spark_partition_id())
    w, col = Window.partitionBy("__range").orderBy("__o"), lambda c: F.col(f"`{c}`")
    stepped = parsed.withColumns({f"__up_{i}": (col(c) >= F.lag(col(c)).over(w)).cast("int") for i, c in enumerate(columns)})
    parts = [F.struct(F.count("*").alias("n"), F.count(col(c)).alias("ok"), F.sum(f"__up_{i}").alias("up"), F.count(f"__up_{i}").alias("steps"), F.min_by(col(c), "__o").alias("first"), F.max_by(col(c), "__o").alias("last")).alias(c) for i, c in enumerate(columns)]
    ranges = stepped.groupBy("__range").agg(F.min("__o").alias("__at"), *parts)
    edge = Window.orderBy("__at")
    edges = ranges.withColumns({f"__edge_{i}": (F.col(f"`{c}`.first") >= F.lag(F.col(f"`{c}`.last")).over(edge)).cast("int") for i, c in enumerate(columns)})
    shares = []
    for i, c in enumerate(columns):
        up, steps = (F.coalesce(F.sum(x), F.lit(0)) for x in (F.coalesce(F.col(f"`{c}`.up"), F.lit(0)) + F.coalesce(f"__edge_{i}", F.lit(0)), F.col(f"`{c}`.steps") + F.col(f"__edge_{i}").isNotNull().cast("int")))
        shares.append(F.struct(F.lit(c).alias("column"), (F.sum(F.col(f"`{c}`.ok")) / F.sum(F.col(f"`{c}`.n"))).alias("parsed"), F.when(steps > 0, up / steps).alias("rising")))
    long = edges.agg(F.array(*shares).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    return long.withColumn("score", F.when(F.col("parsed") >= 0.6, 0.7 * F.col("parsed") + 0.3 * F.coalesce("rising", F.lit(0.0))))


def percentiles(rows: DataFrame, columns: list[str], q: float, width: float = 2e-4) -> dict[str, float | None]:
    """Exact percentile of each column, interpolated between ranks; None for a column of nulls.

    A sketch tells bounds that hold it, rows below them are counted, and only
    the values between them are taken exactly, so no task holds a column. Where the
    ranks lie outside the bounds after all, these are widened tenfold.
    """
    todo, out = list(columns), dict.fromkeys(columns)
    while todo:
        steps = F.array(F.lit(max(0.0, q - width)), F.lit(min(1.0, q + width)))
        found = rows.agg(*[x for i, c in enumerate(todo) for x in (F.count(c).alias(f"n{i}"), F.percentile_approx(c, steps, F.lit(10_000)).alias(f"at{i}"))]).first()
        bounds = {c: (found[f"n{i}"], *found[f"at{i}"]) for i, c in enumerate(todo) if found[f"n{i}"]}
        if width >= 1:  # all of it
            bounds = {c: (n, float("-inf"), float("nan")) for c, (n, _, _) in bounds.items()}  # NaN is the largest
        if not bounds:
            break
        inside = {c: F.col(c).between(F.lit(lo), F.lit(hi)) for c, (_, lo, hi) in bounds.items()}
        counts = rows.agg(*[x for i, (c, (_, lo, _)) in enumerate(bounds.items()) for x in (F.count(F.when(F.col(c) < F.lit(lo), 1)).alias(f"below{i}"), F.count(F.when(inside[c], 1)).alias(f"in{i}"))]).first()
        place = {c: (q * (n - 1) - counts[f"below{i}"], counts[f"in{i}"] - 1) for i, (c, (n, _, _)) in enumerate(bounds.items())}
        held = {c: at / most if most else 0.0 for c, (at, most) in place.items() if 0 <= at <= most}
        if held:
            exact = rows.agg(*[F.percentile(F.when(inside[c], F.col(c)), F.lit(p)).alias(f"p{i}") for i, (c, p) in enumerate(held.items())]).first()
            out |= {c: exact[f"p{i}"] for i, c in enumerate(held)}
        todo, width = [c for c in bounds if c not in held], 10 * width
    return out


def value_shares(rows: DataFrame, least: float = 0.6) -> DataFrame:
    """Of each column: share that reads as a number and the 90th percentile of absolute values; ``rank`` 1 is the guess.

    Columns named as keys come after other numeric ones: a key grows with the table, whatever the amounts are.
    """
    columns = rows.columns
    own = [f"__v{i}" for i in range(len(columns))]
    numbers = rows.select(*[F.abs(F.expr(f"try_cast(cast(`{c}` AS string) AS double)")).alias(v) for c, v in zip(columns, own)])
    share = numbers.agg(*[F.avg(F.col(v).isNotNull().cast("int")).alias(v) for v in own])
    p90 = percentiles(numbers, own, 0.9)
    cells = [F.struct(F.lit(c).alias("column"), F.col(v).alias("numeric"), F.lit(p90[v]).cast("double").alias("p90")) for c, v in zip(columns, own)]
    long = share.select(F.explode(F.array(*cells)).alias("x")).select("x.*")
    place = F.row_number().over(Window.orderBy((F.col("numeric") >= least).desc(), F.lower("column").rlike(KEY_PATTERN), F.col("p90").desc_nulls_last(), "column"))
    return long.withColumn("rank", place)


def pick_by_name(columns: list[str], names: list[str]) -> str | None:
    """The first column that has one of the names, else one that contains it."""
    lower = {c.strip().lower(): c for c in columns}
    for n in names:
        if n in lower:
            return lower[n]
    return next((c for n in names for x, c in lower.items() if n in x), None)


def load_runs(spark: SparkSession, *paths: str) -> DataFrame:
    """Saved forecasts of many runs, with cadence and run from their path."""
    rows = spark.read.parquet(*paths).withColumn("__p", F.col("_metadata.file_path"))
    return rows.withColumns({"cadence": F.regexp_extract("__p", r"(daily|weekly|monthly)", 1), "run": F.regexp_extract("__p", r"run_id=([^/]+)", 1)}).drop("__p")


def read_holidays(spark: SparkSession, path: str) -> DataFrame:
    """``ds``: the days of a list, each once, from its column named ``date``; no day without such a column. Rows that hold no date are left out."""
    rows = read_any(spark, path)
    date = next((c for c in rows.columns if c.strip().lower() == "date"), None)
    if date is None:
        return spark.createDataFrame([], "ds date")
    return rows.select(F.to_date(F.try_to_timestamp(F.col(f"`{date}`").cast("string"))).alias("ds")).where("ds IS NOT NULL").distinct()


def read_ops(spark: SparkSession, *paths: str, cadence: str = "daily") -> DataFrame:
    """``series_id, ds, baseline`` of operational baselines (columns ``date, forecast``) in folders ``series_id=...``, summed to weeks (to Friday) or months where asked."""
    rows = None
    for path in paths:
        own = read_any(spark, path)
        rows = own if rows is None else rows.unionByName(own)
    rows = rows.select(F.col("series_id").cast("string").alias("series_id"), F.to_date(F.try_to_timestamp(F.col("date").cast("string"))).alias("ds"), F.expr("try_cast(forecast AS double)").alias("baseline")).where("ds IS NOT NULL")
    if cadence == "daily":
        return rows
    return rows.groupBy("series_id", bucket_end(cadence).alias("ds")).agg(F.sum("baseline").alias("baseline"))


def discover_runs(spark: SparkSession, root: str, name: str = "predictions") -> list[tuple[str, str, str]]:
    """``(run, cadence, path)`` of each run folder below ``root`` that holds ``outputs/name`` or ``outputs/<cadence>/name``; cadence is empty for the former."""
    jvm, out = spark.sparkContext._jvm, []
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for pattern in (f"{root.rstrip('/')}/*/outputs/{name}", f"{root.rstrip('/')}/*/outputs/{{daily,weekly,monthly}}/{name}"):
        for found in fs.globStatus(jvm.org.apache.hadoop.fs.Path(pattern)) or []:
            parts = found.getPath().toString().split("/")
            cadence = parts[-2] if parts[-3] == "outputs" else ""
            out.append((parts[-4] if cadence else parts[-3], cadence, found.getPath().toString()))
    return sorted(out)


def load_outputs(spark: SparkSession, root: str, name: str = "predictions") -> DataFrame | None:
    """One output of all runs below ``root`` as a table with ``run`` and ``cadence``; None without any."""
    out = None
    for run, cadence, path in discover_runs(spark, root, name):
        own = spark.read.parquet(path).withColumns({"run": F.lit(run), "cadence": F.lit(cadence)})
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def tail_sample(rows: DataFrame, n: int, order: str = "ds") -> DataFrame:
    return rows.orderBy(F.col(order).desc(), *[c for c in rows.columns if c != order]).limit(n)
