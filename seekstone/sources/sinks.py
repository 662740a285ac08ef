"""Writing results so that readers only ever see whole ones."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: The file that names the generation readers use.
POINTER = "current"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def publish(df: DataFrame, home: str, version: int) -> str:
    """Write ``df`` as a new generation and let the pointer name it, once all of it is written.

    A job that fails leaves the pointer as it was. Returns the generation's folder.
    """
    spark, name = df.sparkSession, f"generation-{uuid.uuid4().hex}"
    df.withColumn("version", F.lit(version)).write.parquet(f"{home}/{name}")
    move_pointer(spark, home, {"generation": name, "version": version})
    return f"{home}/{name}"


def move_pointer(spark: SparkSession, home: str, value: dict) -> None:
    """Let the pointer hold ``value``, in one step: readers find the one before or this one."""
    text = json.dumps(value)
    new, fs = _fs(spark, f"{home}/{POINTER}-{uuid.uuid4().hex}")
    out = fs.create(new)
    out.write(bytearray(text.encode()))
    out.close()
    old, _ = _fs(spark, f"{home}/{POINTER}")
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    how = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(new, old, how)


def pointed(spark: SparkSession, home: str) -> dict | None:
    """What the pointer holds; null before the first."""
    at, fs = _fs(spark, f"{home}/{POINTER}")
    return json.loads("".join(r["value"] for r in spark.read.text(f"{home}/{POINTER}").collect())) if fs.exists(at) else None  # one line


def published(spark: SparkSession, home: str) -> tuple[str, int] | None:
    """Folder and version of the generation that the pointer names; null before the first."""
    found = pointed(spark, home)
    return (f"{home}/{found['generation']}", found["version"]) if found else None


def drop_old(spark: SparkSession, home: str) -> int:
    """Delete all generations but the one in use; returns how many."""
    used, (at, fs) = published(spark, home), _fs(spark, home)
    gone = 0
    for status in fs.listStatus(at):
        name = status.getPath().getName()
        if used is not None and name.startswith("generation-") and not used[0].endswith(name):
            gone += bool(fs.delete(status.getPath(), True))
    return gone


def append_log(rows: DataFrame, path: str, recording: bool = True) -> None:
    """Append choices ``(query, item_id, at)`` to the log; counters are derived from it. Nothing where
    recording is off."""
    if recording:
        rows.where("item_id is not null").select("query", "item_id", "at").write.mode("append").parquet(path)


def health(runs: DataFrame) -> DataFrame:
    """``(source, successes, failures, last_success, failures_since)`` of ``runs(source, at, ok)``."""
    last = runs.groupBy("source").agg(F.max(F.when(F.col("ok"), F.col("at"))).alias("last_success"))
    joined = runs.join(last, "source")
    since = ~F.col("ok") & (F.col("last_success").isNull() | (F.col("at") > F.col("last_success")))
    return joined.groupBy("source").agg(F.sum(F.col("ok").cast("long")).alias("successes"), F.sum((~F.col("ok")).cast("long")).alias("failures"), F.max("last_success").alias("last_success"), F.sum(since.cast("long")).alias("failures_since"))
