"""Places and running sums over a whole table in order, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from seekstone.shared import stage


def running_sum(rows: DataFrame, order: list[str | Column], weight: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``weight`` over all rows up to each, in ``order`` (which must be total for
    a result that never varies).

    Rows are dealt by ranges of the order; a range's sums start where the sums of those before it end.
    Only one row a range is in a single task.
    """
    dealt = stage(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("_range").agg(F.sum(weight).alias("_sum"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.join(F.broadcast(starts), "_range").withColumn(name, F.col("_before") + F.sum(weight).over(inside)).drop("_range", "_before")  # a row a partition


def numbered(rows: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """``rows`` with their place in ``order``, from 1."""
    return running_sum(rows, order, F.lit(1).cast("bigint"), name)


def last_before(rows: DataFrame, key: str, marks: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``name``: the value of the last of ``marks(key, value)`` whose key is not above the
    row's own (null before the first); at most one mark a key.

    Rows and marks are dealt by ranges of the key together, so that neither has to be small; what a
    range begins with comes from the ranges before it.
    """
    value = F.struct(F.col("value").alias("v"))  # a value that is null still ends the one before
    both = rows.withColumns({"_mark": F.lit(None).cast(marks.select(value).schema[0].dataType), "_row": F.lit(True)}).unionByName(marks.select(F.col("key").alias(key), value.alias("_mark"), F.lit(False).alias("_row")), allowMissingColumns=True)
    # rows of one key may be many: their own numbers deal them on
    dealt = stage(both.withColumn("_n", F.monotonically_increasing_id()).repartitionByRange(key, "_row", "_n").drop("_n").withColumn("_range", F.spark_partition_id()), "ranges")
    ends = dealt.where("_mark is not null").groupBy("_range").agg(F.max_by("_mark", key).alias("_end"))
    ranges = dealt.select("_range").distinct().join(ends, "_range", "left")  # a row a partition
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("_range", F.last("_end", ignorenulls=True).over(before).alias("_start"))
    inside = Window.partitionBy("_range").orderBy(key, "_row").rowsBetween(Window.unboundedPreceding, 0)
    found = dealt.withColumn("_last", F.last("_mark", ignorenulls=True).over(inside)).where("_row").join(F.broadcast(starts), "_range")
    return found.withColumn(name, F.coalesce("_last", "_start")["v"]).drop("_mark", "_row", "_range", "_last", "_start")
