"""Relevance metrics of ranked results against expected items, and times."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from seekstone.operators.ordered import running_sum


def metrics(results: DataFrame, expected: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``(cases, top1, recall_at_5, mrr)`` of ``results(query_id, rank, id)`` and ``expected(query_id, id)``;
    with ``by``, for each family of cases (columns of ``expected``)."""
    by = by or []
    place = expected.join(results, ["query_id", "id"], "left").groupBy("query_id", *by).agg(F.min("rank").alias("r"))
    share = lambda c: F.coalesce(F.avg(F.coalesce(c, F.lit(False)).cast("double")), F.lit(0.0))
    return place.groupBy(*by).agg(F.count("*").alias("cases"), share(F.col("r") == 1).alias("top1"), share(F.col("r") <= 5).alias("recall_at_5"), F.coalesce(F.avg(F.coalesce(1.0 / F.col("r"), F.lit(0.0))), F.lit(0.0)).alias("mrr"))


def percentile(rows: DataFrame, column: str, by: list[str], p: float) -> DataFrame:
    """``(by..., value)``: the value at place round((n - 1) p) of each group's sorted values, without
    interpolation, by counting from the least value up: no group is gathered."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("n"))
    if by:
        known = counts.withColumns({"upto": F.sum("n").over(Window.partitionBy(*by).orderBy(column)), "total": F.sum("n").over(Window.partitionBy(*by))})
    else:
        known = running_sum(counts, [column], F.col("n"), "upto").join(F.broadcast(counts.agg(F.sum("n").alias("total"))))  # one row
    return known.where(F.col("upto") > F.round((F.col("total") - 1) * p)).groupBy(*by).agg(F.min(column).alias("value"))
