"""Rounds of path doubling never send paths whole: stored, they are a small part of their size."""

from pyspark.sql import functions as F

from seekstone.operators import files


def test_paths_are_joined_by_a_shuffle(spark, monkeypatch):
    plans, stage = [], files.stage

    def staged(df, name):
        if name == "tree-paths":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stage(df, name)

    monkeypatch.setattr(files, "stage", staged)
    nodes = spark.range(300).select(F.col("id").alias("frn"), F.when(F.col("id") % 100 > 0, F.col("id") - 1).alias("parent_frn"), F.lit("d").alias("name"))
    got = {r["frn"]: r["path"] for r in files.tree_paths(nodes).collect()}
    assert got == {k: "\\".join("d" * (k % 100 + 1)) for k in range(300)}
    assert len(plans) == 8 and all("SortMergeJoin" in p and "Broadcast" not in p for p in plans[1:])
