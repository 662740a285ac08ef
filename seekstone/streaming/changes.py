"""A stream of change events kept as the latest state of each key.

Events are read by Structured Streaming. Every micro-batch is reduced to the last event of each key
and merged with the parts of the state that its keys fall in; what a batch writes is in folders named
by its number, so that a batch that is run again replaces its own result and nothing else.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from seekstone.shared import new_folder

VERSIONS = "part int, batch long, parts int"


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key: a partially aggregated maximum."""
    rest = [c for c in rows.columns if c not in (key, *order)]
    return rows.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("m")).select(key, *(F.col(f"m.{c}").alias(c) for c in (*order, *rest)))


def named(rows: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``rows`` has it."""
    while name.lower() in {c.lower() for c in rows.columns}:
        name += "_"
    return name


def newest_parts(spark: SparkSession, home: str, number: int) -> dict[int, tuple[int, int]]:
    """``{part: (batch that wrote it last, number of parts)}`` after batch ``number``."""
    rows = spark.read.schema(VERSIONS).parquet(f"{home}/versions/{number}").collect()  # a row a part
    return {r["part"]: (r["batch"], r["parts"]) for r in rows}


def latest_state(spark: SparkSession, source: str, schema: str, key: str, order: list[str], checkpoint: str | None = None, parts: int = 64) -> DataFrame:
    """State after all Parquet files in folder ``source``, read as a stream of bounded batches.

    With the ``checkpoint`` of an earlier run only new files are read. The state is dealt over
    ``parts`` by hash of the key (a checkpoint keeps its first number); a batch rewrites the parts
    its keys fall in and lists the newest version of every part. Superseded parts stay, so that a
    batch can run again and a reader keeps the state it opened; ``remove_superseded`` deletes them.
    Null is a key like others; without files the state is empty.
    """
    home = checkpoint or new_folder(spark, "stream")

    def apply(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        known = newest_parts(session, home, number - 1) if number > 0 else {}
        count = next(iter(known.values()))[1] if known else parts
        part = named(batch, "part")
        place = F.pmod(F.xxhash64(key), F.lit(count)).cast("int")
        new = latest(batch, key, order).select(*batch.columns).persist()
        try:
            touched = [r["part"] for r in new.select(place.alias("part")).distinct().collect()]  # a row a part
            old = [f"{home}/state/{known[p][0]}/{part}={p}" for p in touched if p in known]
            rows = latest(new.unionByName(session.read.schema(batch.schema).parquet(*old)), key, order).select(*batch.columns) if old else new
            rows.withColumn(part, place).repartition(part).write.mode("overwrite").partitionBy(part).parquet(f"{home}/state/{number}")
        finally:
            new.unpersist()
        now = {p: b for p, (b, _) in known.items()} | dict.fromkeys(touched, number)
        session.createDataFrame([(p, b, count) for p, b in sorted(now.items())], VERSIONS).coalesce(1).write.mode("overwrite").parquet(f"{home}/versions/{number}")

    query = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(source).writeStream.foreachBatch(apply).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    empty = spark.createDataFrame([], schema)
    for last in range(query.lastProgress["batchId"] if query.lastProgress else -1, -1, -1):
        try:
            known = newest_parts(spark, home, last)
        except AnalysisException:  # a run without new files reports a batch that never ran
            continue
        part = named(empty, "part")
        files = [f"{home}/state/{b}/{part}={p}" for p, (b, _) in known.items()]
        return spark.read.schema(schema).parquet(*files) if files else empty
    return empty


def remove_superseded(spark: SparkSession, home: str, number: int) -> int:
    """Delete the parts that neither batch ``number``, the last, nor the one before it lists.

    For times without readers of older states; returns how many folders went.
    """
    kept = {(b, p) for n in (number - 1, number) if n >= 0 for p, (b, _) in newest_parts(spark, home, n).items()}
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{home}/state")
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = 0
    for folder in files.listStatus(root):
        batch = int(folder.getPath().getName())
        for inner in files.listStatus(folder.getPath()):
            name, equals, p = inner.getPath().getName().partition("=")
            if equals and batch <= number and (batch, int(p)) not in kept:
                gone += files.delete(inner.getPath(), True)
    return gone
