"""Windows, manual entries, settings, frames of their own, counts, identities."""

import pytest
from pyspark.sql import functions as F

from seekstone.functions import text as T
from seekstone.operators import catalog as C, files, preferences as P, results as R, search as S
from seekstone.shared import new_folder
from seekstone.streaming import feed, overlay


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_windows(spark):
    windows = spark.createDataFrame([(1, "Mail - Inbox"), (2, "Notes"), (3, " "), (4, None)], "id int, title string")
    queries = spark.createDataFrame([(0, " MAIL "), (1, ""), (2, None), (3, "zzz"), (4, "n")], "query_id int, text string")
    assert [r[:2] for r in rows(R.window_rows(windows, queries))] == [(0, 1), (1, 1), (1, 2), (2, 1), (2, 2), (4, 1), (4, 2)]


def test_manual_entries_and_settings(spark):
    apps = spark.createDataFrame([(1, "C:\\a", "c:\\a", "A", "x"), (2, "C:\\b", "c:\\b", "B", "y")], "id long, path string, path_key string, display_name string, item_id string")
    named = P.rename_manual(apps, spark.createDataFrame([(2, " New "), (9, "none")], "id long, display_name string"))
    assert {r["id"]: r["display_name"] for r in named.collect()} == {1: "A", 2: "New"}
    with pytest.raises(Exception, match="needs a name"):
        P.rename_manual(apps, spark.createDataFrame([(1, "  ")], "id long, display_name string")).collect()
    fresh = P.refresh_manual(apps, spark.createDataFrame([(1, None), (2, " z ")], "id long, item_id string"))
    assert {r["id"]: r["item_id"] for r in fresh.collect()} == {1: "", 2: "z"} and fresh.columns == apps.columns
    held = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    changes = spark.createDataFrame([("a", "5", 1), ("a", "6", 2), ("b", None, 1), ("c", "7", 1)], "key string, value string, at int")
    assert rows(P.save_settings(held, changes)) == [("a", "6"), ("c", "7")]


def test_frames_of_their_own(spark):
    """Frames of kind batch count at once, in their order among rounds."""
    base = spark.createDataFrame([(1, "v", 1, True, "C:\\a"), (2, "v", 2, False, "C:\\a\\x")], "ordinal long, volume string, frn long, is_dir boolean, path string")
    frames = [
        (1, "change", 5, 0, "v", 3, False, ["C:\\open"], False, None),
        (2, "batch", None, 0, "v", 2, False, ["C:\\b"], False, [("v", 2)]),
        (3, "batch", None, 0, "v", 1, True, ["C:\\c"], False, [("v", 3)]),
        (4, "batch", None, 0, "v", 2, False, [], True, [("v", 4)]),
    ]
    source, home = new_folder(spark, "feed"), new_folder(spark, "overlay")
    feed.write_feed(spark.createDataFrame(frames, feed.FRAME), source)
    shown, waiting = overlay.follow(base, source, home, from_feed=True)
    assert {r["path"] for r in shown.collect()} == {"C:\\c"} and [r["seq"] for r in waiting.collect()] == [1]
    state, _, cursors, last = overlay.saved(spark, home)
    assert rows(cursors) == [("v", 4)] and last == 4
    assert overlay.counters(state).first().asDict() == {"objects": 1, "prefixes": 1, "shadow": 2}


def test_identities_are_sorted(spark):
    base = spark.range(200).select(F.col("id").alias("ordinal"), F.concat(F.lit("v"), (F.col("id") % 3).cast("string")).alias("volume"), (F.col("id") * 7 % 50).alias("frn"))
    key = lambda r: (r["volume"], r["frn"], r["ordinal"])
    got = [key(r) for r in files.identities(base).collect()]
    assert got == sorted(got) and len(got) == 200


def test_entries_of_two_kinds(spark):
    apps = spark.createDataFrame([(1, "Display Tool"), (2, "Other")], "id long, name string")
    system = spark.createDataFrame([(10, "Display", ["screen"]), (11, "Sound", ["volume"])], "id long, name string, search_keywords array<string>")
    queries = spark.createDataFrame([(0, "display"), (1, "screen"), (2, "")], "query_id int, text string")
    got = {(r["query_id"], r["rank"]): r["id"] for r in S.search_all(apps, system, queries).collect()}
    assert got == {(0, 1): 10, (0, 2): 1, (1, 1): 10, (2, 1): 1, (2, 2): 2}


def test_texts_that_name_things(spark):
    def told(column, *values):
        frame = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x string")
        return [r["y"] for r in frame.select("k", column(F.col("x")).alias("y")).orderBy("k").collect()]

    templates = ["https://a.example/?q={searchTerms}", "http://a.example/%s/x", "https://a.example/?q=", "https://a.example/x", "ftp://a/?q=", "https:// a/?q=", " ", None]
    assert told(T.valid_template, *templates) == [True, True, True, False, False, False, False, False]
    assert told(T.plugin_url_allowed, "https://a", " HTTP://b ", "file:///c", "https://a\nb", None) == [True, True, False, False, False]
    ids = lambda source: told(lambda x: T.legacy_item_id(x, F.lit(None), F.lit(source)), "C:\\A.exe", "c:/a.exe", "C:\\B.exe")
    one, two = ids("desktop"), ids("start-menu")
    assert one[0] == one[1] != one[2] and one[0] != two[0]  # ids of an earlier form also name the source


def test_candidates_by_channel(spark):
    docs = S.enrich(spark.createDataFrame([(1, "Visual Studio"), (2, "vs tool"), (3, "Other")], "id long, name string"))
    stats = S.channel_stats(docs, S.parse(spark.createDataFrame([(0, "vs")], "query_id int, text string")), fuzzy=False)
    assert {r["channel"]: r["candidates"] for r in stats.collect()} == {"text": 1, "compact": 1, "acronym": 1}


def test_a_programs_own_texts(spark):
    rows_ = spark.createDataFrame([(1, "Tool", "C:\\t.exe", ["own"]), (2, "Other", None, None)], "id long, name string, target string, search_keywords array<string>")
    said = spark.createDataFrame([("c:/T.exe", ["Maker", "Tool", " "]), ("c:\\t.exe", ["Maker", "x" * 600])], "target string, texts array<string>")
    got = {r["id"]: r["search_keywords"] for r in C.with_metadata(rows_, said).collect()}
    assert got == {1: ["own", "Maker"], 2: []}
