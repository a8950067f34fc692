"""Written intermediate tables: they cut lineage, are read column by column, and survive the loss of executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side whose count was taken is broadcast (at some tens of bytes each, a few MB).
BROADCAST_ROWS = 200_000
_STAGED: list[tuple[SparkSession, str]] = []


def stage_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Only a local session may leave it unset, as tests do, and gets a folder of its own; on a cluster that raises, for each
    executor would write to its own disk and what is read back would be incomplete.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write df as Parquet (zstd) into the shared folder and read it back; the files go when the application ends."""
    spark = df.sparkSession
    path = f"{stage_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _STAGED.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Over all cores, where a scan has fewer partitions than there are cores (one small file, say); else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def released() -> None:
    """Remove all that was staged so far; for long sessions, once the results that read it are written."""
    while _STAGED:
        _remove(*_STAGED.pop())


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may have ended before
        pass


def small(df: DataFrame) -> DataFrame:
    """A staged table, broadcast after a count; shuffled beyond BROADCAST_ROWS."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


atexit.register(released)
