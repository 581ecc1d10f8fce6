"""Locked windows in the read path: what lies in them is not read without a reason, and with one each read is logged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "at timestamp, path string, first date, last date, reason string"


class LockedWindow(PermissionError):
    """A locked window was asked for without a reason."""


def read(spark: SparkSession, path: str, date: str, locked: list[tuple[str, str]], window: tuple[str, str] | None = None, reason: str | None = None, log: str | None = None) -> DataFrame:
    """Rows of the Parquet table at ``path``, those of locked windows only for a reason.

    :param date: the column that windows go by; rows without a date belong to none.
    :param locked: first and last day of each locked window.
    :param window: first and last day wanted; None: all days, of which locked ones are left out unless there is a reason.
    :param reason: why locked days are read; written to ``log`` (JSON lines) with each of them before anything is read.

    A window that touches a locked one is refused without a reason, rather than
    cut down in silence. Both conditions are on the stored column, so Spark
    reads no row group that lies in a locked window.
    """
    rows = spark.read.parquet(path)
    day = F.col(date)
    bound = lambda d: F.lit(d).cast("date").cast(rows.schema[date].dataType)
    after = lambda d: F.date_add(F.lit(d).cast("date"), 1).cast(rows.schema[date].dataType)
    if window is not None:
        rows = rows.where((day >= bound(window[0])) & (day < after(window[1])))
    asked = [(a, b) for a, b in locked if window is None or (a <= window[1] and b >= window[0])]
    if not (reason or "").strip():
        if window is not None and asked:
            raise LockedWindow(f"{window[0]} to {window[1]} touches the locked window {asked[0][0]} to {asked[0][1]}; state a reason to read it")
        for a, b in asked:
            rows = rows.where(day.isNull() | (day < bound(a)) | (day >= after(b)))
        return rows
    if asked:
        if log is None:
            raise ValueError("a reason needs a log to be written to")
        entries = spark.createDataFrame([(path, a, b, reason.strip()) for a, b in asked], "path string, first string, last string, reason string")
        entries.select(F.current_timestamp().alias("at"), "path", F.col("first").cast("date"), F.col("last").cast("date"), "reason").coalesce(1).write.mode("append").json(log)
    return rows


def reads(spark: SparkSession, log: str) -> DataFrame:
    """The log: ``at, path, first, last, reason``."""
    return spark.read.schema(LOG).json(log)
