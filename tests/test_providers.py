"""Providers as table functions, and requests of which the latest counts."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from seekstone.functions import providers as V
from seekstone.operators import results as R
from seekstone.operators.requests import Latest

MANIFEST = {"schema_version": 1, "api_version": 1, "id": "demo.words", "entry": "bin/demo"}


@pytest.fixture(scope="module")
def words():
    # within functions, so that they travel to the workers by value
    def words(text):
        return [{"id": k, "title": w, "priority": len(w), "action": {"id": "copy", "payload": {"text": w}}} for k, w in enumerate(text.split())]

    return words


@pytest.fixture(scope="module")
def installed(spark, words):
    def size(text):
        return {"blocks": [{"type": "value", "value": str(len(text))}, {"type": "video", "text": "x"}], "actions": [{"id": "ok", "label": "OK"}]} if text else None


    def broken(text):
        if text == "type":
            return "text"
        if text == "item":
            return [{"title": "no id"}]
        if text == "many":
            return [{"id": k, "title": "x"} for k in range(201)]
        raise RuntimeError("crashed")

    some = V.install(V.Installed(spark), MANIFEST, [V.Provider("split", "list", words, (("keyword", "words"), ("prefix", "w:"))), V.Provider("size", "panel", size, (("prefix", "#"),))])
    return V.install(some, MANIFEST | {"id": "demo.bad"}, [V.Provider("bad", "list", broken, (("keyword", "bad"),))])


def test_lists_panels_and_errors(spark, installed):
    texts = ["words one three", "w:ab", "WORDS", "wordsmith", "#abc", "#", "bad type", "bad item", "bad many", "bad x", "", None, "none of them"]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")
    lists, panels, errors = V.answers(installed, queries)
    got = sorted((r["query_id"], r["place"], r["id"], r["title"], r["score"], r["action"]["payload"]) for r in lists.collect())
    assert got == [(0, 1, "plugin:demo.words:split:1", "three", 905, '{"text": "three"}'), (0, 2, "plugin:demo.words:split:0", "one", 903, '{"text": "one"}'), (1, 1, "plugin:demo.words:split:0", "ab", 902, '{"text": "ab"}')]
    shown = panels.collect()
    assert [(r["query_id"], r["provider"], [b["value"] for b in r["panel"]["blocks"]], r["panel"]["actions"][0]["id"]) for r in shown] == [(4, "demo.words:size", ["3"], "ok")]
    assert {(r["query_id"], r["error"].split(":")[0]) for r in errors.collect()} == {(6, "TypeError"), (7, "KeyError"), (8, "ValueError"), (9, "RuntimeError")}
    # SQL calls a provider by name
    rows = spark.sql("SELECT title FROM provider_demo_words_split('a bc') ORDER BY title").collect()
    assert [r["title"] for r in rows] == ["a", "bc"]
    hits = spark.createDataFrame([(0, "app", 904, 1)], "query_id int, id string, score int, place long")
    both = R.by_score(hits, lists.select("query_id", "id", "score", F.col("place").cast("long").alias("place")))
    assert [r["id"] for r in both.where("query_id = 0").orderBy("place").collect()] == ["plugin:demo.words:split:1", "app", "plugin:demo.words:split:0"]


def test_only_valid_manifests_register(spark, installed, words):
    for wrong in ({"schema_version": 2}, {"api_version": None}, {"id": "Bad Id"}, {"entry": "../x"}, {"entry": "C:\\x"}, {"entry": ""}):
        with pytest.raises(ValueError, match="manifest"):
            V.install(installed, MANIFEST | wrong, [])
    with pytest.raises(ValueError, match="not known"):
        V.install(installed, MANIFEST, [V.Provider("x", "table", words, (("prefix", "x"),))])
    with pytest.raises(ValueError, match="not known"):
        V.install(installed, MANIFEST, [V.Provider("x", "list", words, (("regex", "x"),))])
    lists, panels, errors = V.answers(V.Installed(spark), spark.createDataFrame([(1, "words a")], "query_id int, text string"))
    assert lists.count() == panels.count() == errors.count() == 0


def slow(spark, seconds):
    nap = F.udf(lambda x: time.sleep(seconds) or x, "long")
    return spark.range(0, 4, 1, 4).select(nap("id").alias("x"))


def test_a_newer_request_ends_the_older(spark):
    latest, answers = Latest(spark), {}
    first = threading.Thread(target=lambda: answers.setdefault("old", latest.run(lambda: slow(spark, 120))))
    began = time.time()
    first.start()
    while not spark.sparkContext.statusTracker().getActiveJobsIds() and time.time() - began < 30:
        time.sleep(0.1)
    assert [r["x"] for r in latest.run(lambda: slow(spark, 0))] == [0, 1, 2, 3]
    first.join(60)
    assert not first.is_alive() and answers == {"old": None} and time.time() - began < 90
    tracker = spark.sparkContext.statusTracker()
    for _ in range(100):
        if not tracker.getActiveJobsIds():
            break
        time.sleep(0.1)
    assert not tracker.getActiveJobsIds()


def test_a_request_that_ends_too_late_gives_nothing(spark):
    latest = Latest(spark)

    def overtaken():
        latest.cancel()  # another request comes while this one makes its plan
        return spark.range(3)

    assert latest.run(overtaken) is None
    assert len(latest.run(lambda: spark.range(3))) == 3
    with pytest.raises(Exception, match="no_such"):
        latest.run(lambda: spark.sql("SELECT * FROM no_such_table"))
