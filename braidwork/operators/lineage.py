"""Intermediate tables in the folder that all executors share: they cut the lineage of loops."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def scratch(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only a local master may go without, with one temporary folder of its own."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="braidwork-"))
    return _OWN[0]


def _path(spark: SparkSession, at: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def settled(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, removed when the driver's JVM ends."""
    spark = df.sparkSession
    at = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    p, fs = _path(spark, at)
    fs.deleteOnExit(p)
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._at = at
    return out


def dropped(df: DataFrame) -> None:
    """Removes the table of a settled frame that nothing reads any more."""
    p, fs = _path(df.sparkSession, df._at)
    fs.delete(p, True)
