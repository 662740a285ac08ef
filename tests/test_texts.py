"""Texts that many rows have are searched once; every row still gets its hits."""

import pytest
from pyspark.sql import functions as F

from seekstone.functions import readings
from seekstone.operators import index as I, search as S
from seekstone.plans import live_queries
from seekstone.shared import new_folder

SCHEMA = "id string, name string, search_keywords array<string>, source string, target string"
NAMES = ["red widget", "Red widget", "blue ring", None, "redwidget"]
ASKED = ["red widget", "rign", "ring", "tool kit", "yy", "xx", "colours", "redw"]
EVIDENCE = ("query_id", "id", "name", "score", "tag", "tier", "start", "gaps", "edits", "span", "field", "kind")


def rows_of(n):
    out = [(str(k % 57), NAMES[k % 5], [None, ["tool kit"], []][k % 3], ["start-menu", "desktop"][k % 2], f"C:\\{k}.exe") for k in range(n)]
    return [*out, ("system-tool:tool-kit", "old ring", None, "builtin-system", "x"), ("s", "old ring", None, "win-settings", "ms-settings:colours"), ("t", "old ring", None, "win-settings", "ms-settings:sound")]


@pytest.fixture(scope="module")
def asked(spark):
    return S.parse(spark.createDataFrame(list(enumerate(ASKED)), "query_id int, text string"))


@pytest.fixture(scope="module")
def aliases(spark):
    return spark.createDataFrame([("xx", None, "ring", False), ("yy", "5", "", False), ("yy", None, "blue", True)], "alias string, target_id string, target_name string, builtin boolean")


def found(hits):
    return sorted(map(repr, hits.select(*EVIDENCE).collect()))


@pytest.mark.parametrize("pruned", [True, False])
def test_hits_of_texts_are_those_of_rows(spark, asked, aliases, pruned):
    catalog = spark.createDataFrame(rows_of(200), SCHEMA)
    for given in (None, aliases):
        want = found(S.verify(S.candidates_of(S.enrich(catalog), asked, pruned, True, given)))
        if pruned:  # an id that stands several times is met through any of its rows; what no branch accepts goes
            assert set(found(S.hits(catalog, asked, pruned, True, given))) == set(want)
        else:
            assert found(S.hits(catalog, asked, pruned, True, given)) == want


def scored_rows(monkeypatch):
    seen, score = [], S.verify
    monkeypatch.setattr(S, "verify", lambda met, *a, **k: seen.append(met.count()) or score(met, *a, **k))
    return seen


def test_a_text_is_scored_once(spark, monkeypatch):
    seen = scored_rows(monkeypatch)
    catalog = spark.createDataFrame([(k, ["red widget", "blue ring"][k % 2]) for k in range(300)], "id long, name string")
    queries = spark.createDataFrame([(0, "widget"), (1, "rign")], "query_id int, text string")
    got = S.search(catalog, queries, 5, pruned=False).orderBy("query_id", "rank").collect()
    assert [r["id"] for r in got] == [0, 2, 4, 6, 8, 1, 3, 5, 7, 9] and seen == [4]
    assert S.search(catalog, queries, 1000).count() == 300 and seen[1] <= 4


def test_texts_of_all_fields_are_scored_once(spark, asked, aliases, monkeypatch):
    seen = scored_rows(monkeypatch)
    few, many = (found(S.hits(spark.createDataFrame(rows_of(n), SCHEMA).where("source not like 'win%'"), asked, False, False, aliases)) for n in (300, 600))
    assert seen[0] == seen[1] and len(many) > 1.9 * len(few)


def test_mixed_scripts_are_scored_by_text(spark, monkeypatch, tmp_path):
    seen = scored_rows(monkeypatch)
    rows = spark.createDataFrame([(k, "red widget") for k in range(240)], "p_partkey long, p_name string")
    rows.write.parquet(f"{tmp_path}/part.parquet")
    live_queries.mixed_script_hits(spark, str(tmp_path)).count()
    assert seen[0] <= 12 * len(live_queries.MIXED)


def test_index_keeps_texts_once(spark, asked, aliases, monkeypatch):
    catalog = spark.createDataFrame(rows_of(200), SCHEMA)
    index = I.build(catalog, new_folder(spark, "test-index"), parts=8)
    held = spark.read.parquet(f"{index.segments[0]}/postings").select("id").distinct().count()
    assert held == 5 * 3 + 3  # names, keywords, entries that count by their id
    assert set(found(I.hits(index, asked, True, aliases))) == set(found(S.hits(catalog, asked, True, True, aliases)))
    assert set(found(I.hits(I.compact(index), asked, True, aliases))) == set(found(S.hits(catalog, asked, True, True, aliases)))
    index = I.update(index, catalog.where("id = '6'").withColumn("name", F.lit("blue ring")), spark.createDataFrame([("7",), ("s",)], "id string"))
    now = catalog.where("id not in ('6', '7', 's')").unionByName(catalog.where("id = '6'").withColumn("name", F.lit("blue ring")))
    assert set(found(I.hits(index, asked, True, aliases))) == set(found(S.hits(now, asked, True, True, aliases)))
    seen = scored_rows(monkeypatch)
    I.kept_hits(index, spark.createDataFrame([(0, "ring")], "query_id int, text string"), fuzzy=False)
    assert seen[0] <= held


def test_readings_are_attached_by_text(spark, monkeypatch, tmp_path):
    seen, attach = [], readings.attach
    monkeypatch.setattr(readings, "attach", lambda rows, known: seen.append(rows.count()) or attach(rows, known))
    rows = spark.createDataFrame([(k, ["red widget", "blue ring"][k % 2]) for k in range(240)], "p_partkey long, p_name string")
    rows.write.parquet(f"{tmp_path}/part.parquet")
    assert live_queries.mixed_script_hits(spark, str(tmp_path)).count() > 0 and seen == [12]


@pytest.mark.parametrize("pruned", [True, False])
def test_hits_with_readings_by_text_are_those_of_rows(spark, pruned):
    known = spark.createDataFrame([("微", ["wei"]), ("信", ["xin", "shen"])], "ch string, readings array<string>")
    rows = [(str(k), [None, "微信", "微 pay", "red ring", "信x"][k % 5], [None, ["信"], ["pay", "微信"]][k % 3]) for k in range(60)]
    catalog = spark.createDataFrame(rows, "id string, name string, search_keywords array<string>")
    asked = S.parse(spark.createDataFrame(list(enumerate(["wx", "weixin", "微xin", "shenx", "pay", "ring"])), "query_id int, text string"))
    want = found(S.hits(readings.attach(catalog, known), asked, pruned))
    assert want and found(S.hits(catalog, asked, pruned, known=known)) == want


def test_kept_hits_are_stored_by_text(spark):
    catalog = spark.createDataFrame([(k, ["red widget", "blue ring"][k % 2]) for k in range(300)] + [(8, "red widget")], "id long, name string")
    queries = spark.createDataFrame([(0, "ring"), (1, "widget"), (2, "none")], "query_id int, text string")
    index = I.update(I.build(catalog, new_folder(spark, "test-index"), parts=8), catalog.where("id = 3").withColumn("name", F.lit("ring")), catalog.where("id = 5").select("id"))
    for _ in range(2):  # stored, then read alone
        assert found(I.kept_hits(index, queries)) == found(I.hits(index, S.parse(queries)))
    assert found(I.kept_hits(index, queries))[-1].startswith("Row(query_id=1") and I.kept_hits(index, queries).count() == 149 + 151
    # two texts and one of the update, and the query without hits
    assert spark.read.parquet(f"{index.home}/hits-{index.version}-1").count() == 4
