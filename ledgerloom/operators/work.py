"""Where tables that operators write on the way lie."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession) -> str:
    """A new folder that all executors see: below ``spark.checkpoint.dir``; a temporary one where that is unset and Spark runs in one process."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    shared = shared or tempfile.gettempdir()
    return f"{shared.rstrip('/')}/ledgerloom-{uuid.uuid4().hex}"


def forget(table: DataFrame) -> None:
    """Delete a table that was written on the way (``written_to``) and that nothing reads any more; others are passed over."""
    if hasattr(table, "written_to"):
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
