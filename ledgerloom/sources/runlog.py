"""Sinks: tables, reports as JSON, an append-only experiment log, provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOG = "run_id string, target string, model string, horizon int, mae double, skill double, params map<string,string>, note string"


def write_table(rows: DataFrame, path: str, *by: str, mode: str = "overwrite") -> None:
    """Parquet, in folders by the columns given."""
    rows.write.mode(mode).partitionBy(*by).parquet(path)


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def preview(rows: DataFrame, n: int = 500) -> DataFrame:
    """The first rows by all their columns, the same whatever order they are read in."""
    return rows.orderBy(*rows.columns).limit(n)


def write_variants(variants: DataFrame, path: str, shown: int = 500) -> None:
    """The cleaned data by variant (``data``, in a folder for each), and the first rows of each as one CSV file (``preview``)."""
    write_table(variants, f"{path}/data", "variant")
    place = F.row_number().over(Window.partitionBy("variant").orderBy("series_id", "ds"))
    first = variants.withColumn("place", place).where(F.col("place") <= shown)  # a few from each task, as Spark pushes the limit below the shuffle
    first.orderBy("variant", "place").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/preview")


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    """``series_id, ds, y, is_reported, variant``."""
    return spark.read.schema("series_id string, ds date, y double, is_reported boolean, variant string").parquet(f"{path}/data")


def read_preview(spark: SparkSession, path: str) -> DataFrame:
    """``variant, series_id, ds, y, is_reported, place``."""
    return spark.read.schema("variant string, series_id string, ds date, y double, is_reported boolean, place int").option("header", True).csv(f"{path}/preview")


#: A document for each series: how its forecasts are aligned, whether features tell anything, and the checks of each model.
REPORT = """series_id string, aligned struct<n: long, faulty: long, examples: array<date>>, has_signal boolean,
  models array<struct<model: string, horizon: int, shift: struct<best: int, class: string, naive_equivalent: boolean>, copy: struct<best: int, is_copy: boolean>, n_leaks: long>>"""


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPORT).json(path)


def log_rows(scores: DataFrame, params: dict[str, str], note: str = "") -> DataFrame:
    """Rows for the log; ``run_id`` is a hash of all that describes the run."""
    given = F.create_map(*[F.lit(str(x)) for kv in sorted(params.items()) for x in kv]) if params else F.create_map().cast("map<string,string>")
    rows = scores.select(F.col("series_id").alias("target"), "model", F.col("horizon").cast("int").alias("horizon"), "mae", "skill").withColumns({"params": given, "note": F.lit(note)})
    return rows.withColumn("run_id", F.sha2(F.to_json(F.struct("target", "model", "horizon", "mae", "skill", "params", "note")), 256)).select(*[x.split()[0] for x in LOG.split(", ")])


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def check_log(spark: SparkSession, path: str) -> DataFrame:
    """``run_id, n``: ids that the log has more than once (empty: the log is sound). Raises if the schema is another."""
    rows = spark.read.parquet(path)
    want = [x.split()[0] for x in LOG.split(", ")]
    if sorted(rows.columns) != sorted(want):
        raise ValueError(f"log columns are {rows.columns}")
    return rows.groupBy("run_id").agg(F.count("*").alias("n")).where("n > 1")


def provenance(rows: DataFrame, date: str) -> DataFrame:
    """Rows, latest date and a hash that doesn't depend on the order of rows."""
    return rows.agg(F.count("*").alias("n"), F.max(date).alias("latest"), F.sum(F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)")).cast("string").alias("content_hash"))


def verify(rows: DataFrame, date: str, expected: str) -> None:
    found = provenance(rows, date).first()["content_hash"]
    if found != expected:
        raise ValueError(f"content hash is {found}, not {expected}")
