"""Final lists read their hits and launch groups once."""

from seekstone.operators import preferences as P, ranking

HITS = "query_id int, q string, query string, item_id long, id long, group_id long, name string, source string, score int, tier int, tag string, start int, gaps int, edits int, span int, field int, kind int, boost int"


def hit(k, source):
    return (0, "n", "n", k, k, k // 2, f"n{k}", source, 600 + k, 7, "t", 0, 0, 0, 1, 0, 0, 0)


def ids(spark, *x):
    return spark.createDataFrame([(k,) for k in x], "item_id long")


def leaves(df):
    return df._jdf.queryExecution().optimizedPlan().collectLeaves().size()


def test_hideable_hits_go_in_one_pass(spark, tmp_path):
    sources = ["desktop", "desktop", "builtin-system", "builtin-system", None, None, "uninstall"]
    spark.createDataFrame([hit(k, s) for k, s in enumerate(sources)] + [hit(0, "start-menu")], HITS).write.parquet(f"{tmp_path}/hits")
    lifted = P.personalize(spark.read.parquet(f"{tmp_path}/hits"), ids(spark), spark.createDataFrame([], "group_id long"), ids(spark, 0, 2, 4, 6, 6))
    assert sorted(r["item_id"] for r in lifted.collect()) == [1, 2, 3, 4, 5]
    assert leaves(lifted) == 4  # hits, hidden, pinned, demoted


def test_groups_are_worked_out_once(spark, tmp_path):
    rows = [(k, f"n{k}", "desktop") for k in range(4)]
    catalog = spark.createDataFrame(rows, "id long, name string, source string")
    spark.createDataFrame([(k, k // 2) for k in range(4)], "id long, group_id long").write.parquet(f"{tmp_path}/groups")
    none = [spark.createDataFrame([], s) for s in ("query string, item_id long, n long, share double, last_used long", "item_id long, launches long, last_used long")]
    hits = spark.createDataFrame([hit(k, "desktop") for k in range(4)], HITS).drop("query", "item_id", "group_id", "boost")
    shown = ranking.finish(hits, catalog, spark.read.parquet(f"{tmp_path}/groups"), *none, ids(spark), ids(spark), ids(spark, 0), 0)
    assert [(r["rank"], r["id"], r["score"]) for r in shown.orderBy("rank").collect()] == [(1, 2, 603), (2, 1, 601)]
    assert not any(str(tmp_path) in f for f in shown.inputFiles())
