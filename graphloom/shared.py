"""Tables in the folder that all executors see: they cut a plan's lineage and outlive lost executors."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset on one machine (tests), an own one is set; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(spark: SparkSession, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df as a table in the shared folder, read again."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> bool:
    """Asks for the shuffle files of finished plans to be deleted now: Spark does so once its driver has collected the plans' objects. The driver's JVM
    then gives freed memory back to the system, its heap's and what malloc keeps for it (code generation and compilers free much): true if it could."""
    gc.collect()
    spark._jvm.System.gc()
    jvm = spark._jvm
    try:
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        # by the interface's method, as py4j cannot reach that of the server's own class
        call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        given = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        call.invoke(server, given)
    except Py4JError:  # a JVM, or a C library, without it
        return False
    return True
