"""The catalog engine on small cases, and every query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from seekstone.functions import routing, text as T
from seekstone.graph import connected_components
from seekstone.operators import catalog as C, files, preferences as P, search as S
from seekstone.plans.catalog_queries import ORACLE_SQL, QUERIES
from seekstone.streaming import changes

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("a, b, d", [("chorme", "chrome", 1), ("ca", "abc", 3), ("", "ab", 2), ("ab", "", 2), ("same", "same", 0), ("kitten", "sitting", 3)])
def test_osa_distance(spark, a, b, d):
    assert one(spark, T.osa_distance(F.lit(a), F.lit(b))) == d


def test_fuzzy_budget_and_score(spark):
    assert one(spark, T.fuzzy_score(F.lit("chorme"), F.lit("chrome"))) == 400
    assert one(spark, T.fuzzy_score(F.lit("ab"), F.lit("ac"))) is None
    assert one(spark, T.fuzzy_score(F.lit("chrome"), F.lit("chrome"))) is None


def test_names(spark):
    assert one(spark, T.normalize(F.lit("  Visual\u3000Studio\t Code "))) == "visual studio code"
    assert one(spark, T.split_camel(F.lit("PowerPoint2-XMLReader"))) == ["power", "point2", "xml", "reader"]
    assert one(spark, T.acronym(T.tokens(F.lit("visual studio code")))) == "vsc"
    assert one(spark, T.acronym(T.tokens(F.lit("code")))) == ""
    assert one(spark, T.grams(F.lit("ab"), 3)) == []
    assert sorted(one(spark, T.delete_variants(F.lit("abc")))) == ["a", "ab", "ac", "b", "bc", "c"]
    assert one(spark, T.family_key(F.lit("Chrome  Beta (x64)"))) == "chrome beta"


def test_urls_and_paths(spark):
    assert one(spark, T.percent_encode(F.lit("a b*~+é"))) == "a%20b%2A~%2B%C3%A9"
    assert one(spark, T.search_url(F.lit("https://x/?q=%s"), F.lit("a b"))) == "https://x/?q=a%20b"
    assert one(spark, T.normalize_url(F.lit("example.com/x"))) == "https://example.com/x"
    assert one(spark, T.normalize_url(F.lit("setup.exe"))) is None
    assert one(spark, T.extension(F.lit("C:\\a.b\\NAME"))) == ""
    assert one(spark, T.under(F.lit("C:\\Win\\x"), F.lit("c:/win/"))) and not one(spark, T.under(F.lit("C:\\Windows"), F.lit("C:\\Win")))
    assert one(spark, T.arguments_equal(F.lit(" -a /from=x"), F.lit("-a")))


def test_search_orders_and_recalls(spark):
    names = ["Chrome", "Chromium", "Google Chrome", "Visual Studio Code", "Code", "", None]
    catalog = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    queries = spark.createDataFrame(list(enumerate(["chrome", "vsc", "visual code", "chorme", "  ", "studiocode"])), "query_id int, text string")
    pruned = S.search(catalog, queries).collect()
    whole = S.search(catalog, queries, pruned=False).collect()
    best = {r["query_id"]: (r["name"], r["score"], r["tag"]) for r in pruned if r["rank"] == 1}
    assert best == {0: ("Chrome", 1000, "exact"), 1: ("Visual Studio Code", 680, "acronym"), 2: ("Visual Studio Code", 880, "token-seq"), 3: ("Chrome", 400, "fuzzy"), 4: ("Chrome", 0, "default"), 5: ("Visual Studio Code", 780, "compact-substring")}
    assert {tuple(r) for r in pruned} == {tuple(r) for r in whole}


def test_boosts(spark):
    day = P.DAY
    assert one(spark, P.recency_score(F.lit(100), 100)) == 0 and one(spark, P.recency_score(F.lit(100), 100 + day // 2)) == 40 and one(spark, P.recency_score(F.lit(100), 100 + 7 * day)) == 0
    assert one(spark, P.pair_score(F.lit(10), F.lit(1.0), F.lit(0), day)) == round(30 + 14 * math.log(10))
    assert one(spark, P.pair_score(F.lit(2), F.lit(1.0), F.lit(0), day)) == 40


def test_pins_demotions_and_hidden(spark):
    hits = spark.createDataFrame([("q", 1, 500, 8, 50), ("q", 2, 1000, 1, 0), ("q", 3, 600, 7, 0), ("q", 4, 900, 3, 0)], "query string, item_id long, score int, tier int, boost int")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "item_id long")
    got = {r["item_id"]: (r["score"], r["why"]) for r in P.personalize(hits, ids(1), ids(2, 3), ids(4)).collect()}
    assert got == {1: (680, "+pin"), 2: (1000, ""), 3: (420, "+demote")}


def test_items_without_a_pair_are_lifted_by_their_use(spark):
    hits = spark.createDataFrame([("q", 1), ("q", 2), ("q", 3)], "query string, item_id long")
    pairs = spark.createDataFrame([("q", 1, 1, 0, 1.0)], "query string, item_id long, n long, last_used long, share double")
    usage = spark.createDataFrame([(2, 500, P.DAY * 400 - 60), (1, 1, 0)], "item_id long, launches long, last_used long")
    assert {r["item_id"]: r["boost"] for r in P.with_boosts(hits, pairs, usage, P.DAY * 400).collect()} == {1: 30 + 10, 2: 45 + 40, 3: 0}


def test_components_of_a_star_a_path_and_nothing(spark):
    edges = [(0, k) for k in range(1, 200)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5), (None, 3)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[k] == 0 for k in range(200)) and all(found[1000 + k] == 1000 for k in range(61))
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_dedupe_and_groups(spark):
    rows = spark.createDataFrame([(1, "Word", "C:\\o\\w.exe", None, "desktop"), (2, "MS Word", "c:/o/W.exe", " ", "start-menu"), (3, "Other", "C:\\x\\o.exe", "-a", "uninstall"), (4, "word (x64)", "C:\\o\\z.exe", None, "commands")], "id long, name string, target string, args string, source string")
    assert {(r["id"], tuple(r["keywords"])) for r in C.dedupe(rows).collect()} == {(2, ("Word",)), (3, ()), (4, ())}
    groups = C.launch_groups(rows)
    assert {r["id"]: r["group_id"] for r in groups.collect()} == {1: 1, 2: 1, 3: 3, 4: 1}
    assert {r["group_id"]: r["id"] for r in C.representatives(rows, groups).collect()} == {1: 2, 3: 3}


def test_files(spark):
    rows = spark.createDataFrame([("C:\\a\\b\\x.png",), ("C:\\ab\\y.txt",)], "path string")
    moves = spark.createDataFrame([("C:\\a", "D:\\z"), ("C:\\a\\b", "E:")], "base string, now string")
    assert {r["current"] for r in files.renamed(rows, moves).collect()} == {"E:\\x.png", "C:\\ab\\y.txt"}
    assert [r["path"] for r in files.outside(rows, spark.createDataFrame([("c:/a/",)], "folder string")).collect()] == ["C:\\ab\\y.txt"]
    tree = spark.createDataFrame([(1, None, "C:"), (2, 1, "a"), (3, 2, "b"), (4, 5, "x"), (5, 4, "y")], "frn long, parent_frn long, name string")
    assert {r["frn"]: r["path"] for r in files.tree_paths(tree).collect()} == {1: "C:", 2: "C:\\a", 3: "C:\\a\\b"}


def test_routing(spark):
    triggers = spark.createDataFrame([("calc", "prefix", "=", 0), ("win", "keyword", "w", 1)], "provider string, kind string, value string, place int")
    queries = spark.createDataFrame([(0, "=1+1"), (1, "w notes"), (2, "word"), (3, "W")], "query_id int, text string")
    assert {(r["query_id"], r["provider"], r["rest"]) for r in routing.route(queries, triggers).collect()} == {(0, "calc", "1+1"), (1, "win", "notes"), (3, "win", "")}


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    schema, home, source = "k long, n long, v string", f"file://{tmp_path}/home", f"{tmp_path}/in"
    spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (1, 2, "c")], schema).coalesce(1).write.parquet(f"{source}/x")
    spark.createDataFrame([(3, 1, "d")], schema).coalesce(1).write.parquet(f"{source}/y")
    read = lambda: {tuple(r) for r in changes.latest_state(spark, f"{source}/*", schema, "k", ["n"], home).collect()}
    assert read() == {(1, 2, "c"), (2, 1, "b"), (3, 1, "d")}
    spark.createDataFrame([(2, 5, "z")], schema).coalesce(1).write.parquet(f"{source}/z")
    assert read() == {(1, 2, "c"), (2, 5, "z"), (3, 1, "d")}
    assert read() == {(1, 2, "c"), (2, 5, "z"), (3, 1, "d")}


def test_stream_rewrites_touched_parts_only(spark, tmp_path):
    """Equal to brute force after each run; null keys, a column named part, untouched parts as they were."""
    schema, home, source = "k long, n long, part string", f"file://{tmp_path}/home", f"{tmp_path}/in"
    state = {}
    runs = [[(k, 1, f"a{k}") for k in range(40)] + [(None, 1, "null")], [(3, 2, "b"), (3, 1, "old"), (None, 3, "n")], [(7, 9, "c"), (99, 1, "new")]]
    for i, rows in enumerate(runs):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{source}/{i}")
        for k, n, v in rows:
            state[k] = max(state.get(k, (0, "")), (n, v))
        got = changes.latest_state(spark, f"{source}/*", schema, "k", ["n"], home, 8)
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((k, *v)) for k, v in state.items())
    folders = lambda b: {x.name for x in (tmp_path / "home" / "state" / str(b)).iterdir() if "=" in x.name}
    assert len(folders(0)) == 8 and len(folders(1)) <= 2 and len(folders(2)) <= 2
    stale = len(folders(1))  # their versions of batch 0 are listed neither after batch 1 nor after batch 2
    assert changes.remove_superseded(spark, home, 2) == stale and len(folders(0)) == 8 - stale
    again = changes.latest_state(spark, f"{source}/*", schema, "k", ["n"], home, 8)
    assert sorted(map(str, map(tuple, again.collect()))) == sorted(str((k, *v)) for k, v in state.items())


def test_stream_of_no_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert changes.latest_state(spark, f"{tmp_path}/in", "k long, n long", "k", ["n"], f"file://{tmp_path}/home").count() == 0


def plain(x):
    if isinstance(x, float):
        return round(x, 9)
    return int(x) if hasattr(x, "__int__") and not isinstance(x, (str, bool)) else x


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = QUERIES[name](spark, DATA)
    wanted = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in wanted.description]
    assert sorted(names) == sorted(got.columns)
    rows = got.select(*names).collect()
    assert sorted(repr([plain(v) for v in r]) for r in rows) == sorted(repr([plain(v) for v in r]) for r in wanted.fetchall())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry_module.queries()) and set(ORACLE_SQL) <= set(entry_module.oracle_sql())
    assert os.path.exists(DATA)


def test_short_queries_find_what_the_unpruned_search_finds(spark):
    names = ["Blue Ring", "red widget", "Rapid Web", "web r", "cab", "b", "é bolt", "xébz", "\u5fae\u4fe1 app", "zzz", ""]
    catalog = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    queries = spark.createDataFrame(list(enumerate(["b", "r w", "é", "é b", "\u5fae", "\u5fae\u4fe1", "w", "r", "q"])), "query_id long, text string")
    pruned, whole = ({tuple(r) for r in S.search(catalog, queries, k=20, pruned=p, fuzzy=False).collect()} for p in (True, False))
    assert pruned == whole and len([r for r in whole if r[0] == 0]) == 7 and len([r for r in whole if r[0] == 1]) == 2
