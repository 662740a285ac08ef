"""Absorbed discoveries and launch groups of catalogs in which very many rows are alike."""

import random

from pyspark.sql import functions as F

from seekstone.operators import catalog as C

SCHEMA = "id long, name string, target string, args string, source string"


def test_program_keys_equal_pairwise_tests(spark, monkeypatch):
    rng = random.Random(4)
    names, files = ["Edit", "edit (x64)", "Editor Pro", "ed it", "", None, "Viewer"], ["edit.exe", "viewer.exe", "EDIT.lnk", "ab.exe", "e d.exe"]
    rows = [(k, rng.choice(names), rng.choice(["C:\\A\\", "c:\\a\\bin\\", "D:\\B\\", "shell:AppsFolder\\", "x", None]), rng.choice([None, "", "-v", " -v /from=x"]), rng.choice(["uninstall", "app-paths", "start-menu", "builtin"])) for k in range(160)]
    catalog = spark.createDataFrame([(k, n, t and t + rng.choice(files), a, s) for k, n, t, a, s in rows], SCHEMA)
    found = C.keys_of(catalog.where(F.col("source").isin(*C.SUPPLEMENTAL)), "a")
    hosts = C.keys_of(catalog.where(C.layer(F.col("source")).isin("Formal", "System")), "b")
    want = sorted(map(tuple, found.crossJoin(hosts).where(C.same_program("a", "b")).groupBy("a_id").agg(F.min("b_id")).collect()))
    monkeypatch.setattr(C, "same_program", None)  # no pair of rows is compared
    got = sorted((r["loser"], r["winner"]) for r in C.absorb_pairs(catalog).collect())
    assert got == want and len(got) > 20


def test_rows_that_say_the_same_are_one_node(spark, monkeypatch):
    edges, components = [], C.connected_components
    monkeypatch.setattr(C, "connected_components", lambda e: edges.append(e.count()) or components(e))
    alike = [(k, ["Edit", "Edit (x64)"][k % 2], f"C:\\A\\{k % 2}.exe", None, "desktop") for k in range(400)]
    rows = spark.createDataFrame([*alike, (900, "Edit", None, None, "desktop"), (901, "Edit", None, None, "desktop"), (902, "x", "C:\\z.exe", "", "desktop"), (903, "x", "C:\\z.exe", "", "desktop")], SCHEMA)
    got = {r["id"]: r["group_id"] for r in C.launch_groups(rows).collect()}
    assert got == {k: 0 for k in range(400)} | {900: 900, 901: 901, 902: 902, 903: 902}
    assert edges[0] <= 12
