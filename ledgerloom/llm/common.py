"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``; a temporary one where it is unset and Spark runs in one process (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder is None:
        kept = spark.sparkContext.getCheckpointDir()
        if kept is None and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = kept or tempfile.mkdtemp(prefix="ledgerloom-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from there, so that a lost executor costs no recomputation.

    Parquet takes less room than a checkpoint's rows. Shuffle files that led to
    the table are needed no more; Spark removes them when the driver's JVM
    collects their plans, which is asked for here, as disks would fill up
    before it happens by itself.
    """
    spark = df.sparkSession
    path = scratch(spark, "cut")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` has written and nothing reads any more; others are passed over."""
    for t in tables:
        if not hasattr(t, "written_to"):
            continue
        spark = t.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder of its own below the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored_bytes(rows: DataFrame) -> int:
    """Bytes of the files that ``rows`` are read from; 0 where they come from none."""
    spark, jvm = rows.sparkSession, rows.sparkSession.sparkContext._jvm
    conf, total = spark.sparkContext._jsc.hadoopConfiguration(), 0
    for name in rows.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        total += path.getFileSystem(conf).getFileStatus(path).getLen()
    return total


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, text)`` with a null text as the empty one; every other column, whatever its name, stays behind."""
    return docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def unused(rows: DataFrame, name: str) -> str:
    """``name``, or the first of ``name_1``, ``name_2`` ... that no column has (Spark doesn't tell case apart)."""
    taken, n = {c.lower() for c in rows.columns}, 0
    while (found := f"{name}_{n}" if n else name).lower() in taken:
        n += 1
    return found


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
