"""Connected components as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seekstone.shared import discard, stage


def connected_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """Components of the undirected graph ``edges(a, b)`` as ``(node, component)``.

    ``component`` is the smallest node of the component. Nodes without edges are not returned;
    rows with a null end, self loops and repeated edges have no effect; no edges give no rows.

    Alternating large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce
    and Beyond", 2014): O(log n) rounds. Each step shuffles the edges by node and keeps at most one
    row per edge, and the minimum of a neighbourhood is a partially aggregated ``min`` that is
    joined back, so that a node with very many neighbours is never gathered in one task. Each half
    round is staged in the shared folder, and the one before it is deleted; rounds end when the edges
    no longer change. Components that ``max_rounds`` do not finish are an error, never a result.
    """
    clean = (
        edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        .where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    )
    e = stage(clean.distinct(), "edges")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = state(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        previous, e = e, stage(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "small")
        after = state(e)
        discard(large)
        discard(previous)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components are not final after {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
