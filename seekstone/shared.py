"""Staging of intermediate results in the folder that driver and executors share.

A staged table cuts lineage the way ``checkpoint()`` does, but keeps columns typed and compressed,
and survives the loss of any executor.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a folder of our own on one machine.

    A cluster's executors would each write to a disk of their own there, so it must state the folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = spark.conf.get("seekstone.shared.dir", None)
    if not own:
        own = "file://" + tempfile.mkdtemp(prefix="spark-seekstone-")
        spark.conf.set("seekstone.shared.dir", own)
        spark.sparkContext.setCheckpointDir(own)
    return own


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other job uses."""
    return f"{shared_dir(spark)}/seekstone/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return it reread."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(staged: DataFrame) -> None:
    """Delete the files of a staged table that no later plan reads."""
    spark = staged.sparkSession
    home = f"{shared_dir(spark)}/seekstone/"
    for folder in {f.rpartition("/")[0] for f in staged.inputFiles()}:
        if "/seekstone/" in folder and folder.rpartition("/")[0].rstrip("/").endswith(home.rstrip("/").rpartition(":")[2].lstrip("/")):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let the driver give back what finished plans and broadcasts held.

    A long pipeline ends hundreds of plans in one driver; their Python handles keep them alive until
    Python collects its garbage, and the C library keeps what the JVM's compiler freed.
    """
    gc.collect()
    jvm = spark._jvm
    jvm.System.gc()
    # The bean is reached through its interface: its own class is not open to reflection.
    array, text = spark.sparkContext._gateway.new_array, jvm.java.lang.String
    kind = lambda name: jvm.java.lang.Class.forName(name)
    kinds, given = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
    for k, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[k] = kind(name)
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    given[2], given[3] = array(jvm.java.lang.Object, 0), array(text, 0)
    beans = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    try:
        kind("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(beans, given)
    except Py4JError:  # only some JVMs have this command
        pass
