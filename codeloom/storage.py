"""Tables written once to the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of our own only where the session names none, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="codeloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _at_exit(spark: SparkSession, path: str) -> None:
    def drop() -> None:
        context = spark.sparkContext
        if context._jsc is not None and context._jvm is not None:
            try:
                delete(spark, path)
            except Exception:  # the JVM is going down: its folder is swept by the cluster
                return

    atexit.register(drop)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/codeloom/{name}-{uuid.uuid4().hex}"
    _at_exit(spark, path)
    return path


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` written as Parquet and read again: its lineage ends here and survives the loss of any executor.

    ``by`` is its last column if each of its values is to have a folder of its own.
    """
    path = fresh_path(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: int | None = None, limit: int = 64 << 20) -> DataFrame:
    """``df`` marked for broadcast if its rows come to at most ``limit`` bytes; else as it is, to be shuffled.

    The rows' own sizes are measured, so ``df`` should be a written table. Rows that cannot be larger than ``row_bytes``
    are only counted, and the count stops as soon as the limit is passed.
    """
    if row_bytes is None:
        size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))) + F.lit(16))).first()[0] or 0
        return F.broadcast(df) if size <= limit else df
    most = limit // row_bytes
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def dealt(df: DataFrame, most: int) -> DataFrame:
    """``df`` in parts of about ``most`` rows, where each row costs much more than it is long."""
    parts = -(-df.count() // most)
    return df if parts < 2 else df.repartition(parts)
