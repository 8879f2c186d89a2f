"""Folders that the driver and all executors see, and manifests: JSON rows, the newest of which says what is live."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, what: str) -> str:
    """A new path under spark.checkpoint.dir; where that is unset, a local session's own temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="ledgerlark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts that fit a small Python worker, whatever the input: 1,000 rows and 8 MB at most."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def small_methods(spark: SparkSession) -> None:
    """Rows' code in methods that the JVM compiles: a stage whose one method is over its limit of 8,000 bytes is interpreted, several times slower; its parts are not."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def latest(spark: SparkSession, path: str, schema: str, collection: str) -> Row | None:
    """The newest manifest row of a collection.  A row is one file, which appears whole when its job commits."""
    if not exists(spark, path):
        return None
    rows = spark.read.schema(schema).json(path).where(F.col("collection") == collection)
    return rows.orderBy(F.desc("version"), F.desc("built_at")).first()


def record(row: DataFrame, path: str) -> None:
    """Append one manifest row: the last step of a change, before which readers see the old state."""
    row.coalesce(1).write.mode("append").json(path)
