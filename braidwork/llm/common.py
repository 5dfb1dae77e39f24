"""Shared plumbing: tables in the folder that all executors see, and names that can't clash."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from ..operators.graph import components as connected_components  # noqa: F401
from ..operators.lineage import dropped, scratch  # noqa: F401
from ..operators.lineage import settled as written  # noqa: F401


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def freed(spark: SparkSession) -> None:
    """Has the driver's JVM give back what finished jobs leave: broadcasts and shuffles that nothing reads any more, and native memory.

    What the JVM's compiler and buffers have freed otherwise stays with glibc,
    and the heap grows with broadcasts; tidy() does the same for Python.
    """
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    jvm.System.gc()
    lang = jvm.java.lang
    try:  # by the interface: the server's own class is hidden
        invoke = next(m for m in getattr(lang, "Class").forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = gateway.new_array(lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JJavaError:  # not HotSpot on glibc
        pass


def hidden(df: DataFrame):
    """(df with names of its own, a function from the old names to them): no column then clashes with an operator's."""
    cols = df.columns
    names = [f"__c{i}" for i in range(len(cols))]
    return df.toDF(*names), lambda c: names[cols.index(c)]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
