"""The feed data source: rotation, restart, gaps, reclaim and loss; staleness and the catch-up barrier."""

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from seekstone.shared import new_folder
from seekstone.streaming import feed, overlay

BASE = "ordinal long, volume string, frn long, is_dir boolean, path string"


def frames_of(spark, seqs, cursors=None):
    """A change and a commit in turn: file n appears under the name f<n>; commits carry cursors."""
    rows = []
    for s in seqs:
        if s % 2:
            rows.append((s, "change", s // 2, 0, "v", 100 + s, False, [f"C:\\f{s}"], False, None))
        else:
            rows.append((s, "round_commit", s // 2 - 1, None, None, None, None, None, None, [("v", s), ("w", 7)] if cursors else None))
    return spark.createDataFrame(rows, feed.FRAME).repartition(3)


@pytest.fixture()
def base(spark):
    return spark.createDataFrame([(1, "v", 1, False, "C:\\old")], BASE)


def names(df):
    return {r["path"] for r in df.collect()}


def test_segments_rotate_and_are_reclaimed(spark, base):
    source, home = new_folder(spark, "feed"), new_folder(spark, "overlay")
    folder = Path(source.removeprefix("file://"))
    feed.write_feed(frames_of(spark, range(1, 21)), source, segment_bytes=400)
    held = feed.manifest(source)
    assert len(held["segments"]) > 3 and held["through"] == 20 and all(s["bytes"] <= 400 for s in held["segments"])
    assert [s["first"] for s in held["segments"][1:]] == [s["through"] + 1 for s in held["segments"][:-1]]
    feed.register(spark)
    assert [r["seq"] for r in spark.read.format("feed").load(source).orderBy("seq").collect()] == list(range(1, 21))
    shown, waiting = overlay.follow(base, source, home, from_feed=True)
    assert names(shown) == {"C:\\old"} | {f"C:\\f{s}" for s in range(1, 20, 2)} and waiting.count() == 0
    assert feed.load(source, feed.ACKNOWLEDGED)["segment"] == len(held["segments"])
    # what is acknowledged goes with the next commit, what is not stays; a later run reads on
    feed.write_feed(frames_of(spark, range(21, 26)), source, segment_bytes=400)
    left = feed.manifest(source)["segments"]
    assert left[0]["first"] == 21 and {p.name for p in folder.glob("*.jsonl")} == {s["name"] for s in left}
    shown, waiting = overlay.follow(base, source, home, from_feed=True)
    assert names(shown) == {"C:\\old"} | {f"C:\\f{s}" for s in range(1, 24, 2)} and waiting.count() == 1
    # a consumer that comes late cannot have all: an error, never a part
    late = new_folder(spark, "overlay")
    with pytest.raises(Exception, match="removed before they were read"):
        overlay.follow(base, source, late, from_feed=True)
    overlay.freeze(spark.createDataFrame([], overlay.CURSORS), late)
    with pytest.raises(overlay.StaleFeed, match="removed before"):
        overlay.present(base, late, source)


def test_retained_bytes_keep_acknowledged_segments(spark, base):
    source = new_folder(spark, "feed")
    feed.write_feed(frames_of(spark, range(1, 11)), source, segment_bytes=300)
    overlay.follow(base, source, from_feed=True)
    kept = feed.manifest(source)["segments"][-2:]
    feed.write_feed(frames_of(spark, range(11, 13)), source, segment_bytes=300, retain_bytes=sum(s["bytes"] for s in kept))
    assert [s["number"] for s in feed.manifest(source)["segments"][:2]] == [s["number"] for s in kept]


def test_gaps_and_damage_are_errors(spark, base):
    source = new_folder(spark, "feed")
    feed.write_feed(frames_of(spark, range(1, 5)), source)
    before = feed.manifest(source)
    for wrong in ([6, 7], [3, 4], [5, 7]):
        with pytest.raises(Exception, match="follow"):
            feed.write_feed(frames_of(spark, wrong), source)
    assert feed.manifest(source) == before
    path = Path(source.removeprefix("file://")) / before["segments"][0]["name"]
    whole = path.read_text().splitlines(keepends=True)
    for text, said in ((whole[:1] + whole[2:], "does not follow"), (whole[:-2] + whole[-1:], "does not end"), (whole[:-1], "does not end")):
        path.write_text("".join(text))
        with pytest.raises(Exception, match=said):
            spark.read.format("feed").load(source).collect()
    home = new_folder(spark, "overlay")
    overlay.freeze(spark.createDataFrame([], overlay.CURSORS), home)
    with pytest.raises(Exception, match="does not end"):
        overlay.follow(base, source, home, from_feed=True)
    with pytest.raises(overlay.StaleFeed, match="does not end"):
        overlay.present(base, home, source)


def test_readers_wait_and_refuse(spark, base):
    source, home = new_folder(spark, "feed"), new_folder(spark, "overlay")
    overlay.freeze(spark.createDataFrame([("v", 4), ("w", 7)], overlay.CURSORS), home)
    with pytest.raises(overlay.NotReady, match="nothing"):
        overlay.present(base, home, source)
    feed.write_feed(frames_of(spark, range(1, 3), cursors=True), source)
    overlay.follow(base, source, home, from_feed=True)
    with pytest.raises(overlay.NotReady, match="target"):
        overlay.present(base, home, source, timeout=600)
    feed.write_feed(frames_of(spark, range(3, 5), cursors=True), source)
    overlay.follow(base, source, home, from_feed=True)
    now = time.time()
    feed.beat(source, now)
    assert names(overlay.present(base, home, source, now + 4)) == {"C:\\old", "C:\\f1", "C:\\f3"}
    with pytest.raises(overlay.StaleFeed, match="sign of life"):
        overlay.present(base, home, source, now + 6)
    feed.beat(source, now + 6)
    assert overlay.present(base, home, source, now + 6).count() == 3


def test_a_running_overlay_tells_its_state(spark, base):
    source, home = new_folder(spark, "feed"), new_folder(spark, "overlay")
    overlay.freeze(spark.createDataFrame([], overlay.CURSORS), home)
    feed.write_feed(frames_of(spark, range(1, 3)), source)
    query, watch = overlay.start(base, source, home, from_feed=True)
    try:
        query.processAllAvailable()
        assert names(overlay.present(base, home, source, timeout=600)) == {"C:\\old", "C:\\f1"}
        # the producer loses a segment that was never read
        feed.write_feed(frames_of(spark, range(3, 5)), source)
        held = feed.manifest(source)
        Path(source.removeprefix("file://"), held["segments"][-1]["name"]).unlink()
        with pytest.raises(Exception):
            query.processAllAvailable()
            query.awaitTermination(60)
        for _ in range(100):
            if overlay.pointed(spark, f"{home}/status")["state"] == "stale":
                break
            time.sleep(0.2)
        with pytest.raises(overlay.StaleFeed):
            overlay.present(base, home, source, timeout=600)
    finally:
        query.stop()
        spark.streams.removeListener(watch)


def test_streaming_sink_copies_a_feed(spark):
    source, to = new_folder(spark, "feed"), new_folder(spark, "feed")
    feed.write_feed(frames_of(spark, range(1, 31)), source, segment_bytes=500)
    query = spark.readStream.format("feed").load(source).writeStream.format("feed").option("checkpointLocation", new_folder(spark, "copy")).option("path", to).start()
    try:
        query.processAllAvailable()
        feed.write_feed(frames_of(spark, range(31, 41)), source, segment_bytes=500)
        query.processAllAvailable()
    finally:
        query.stop()
    both = [sorted(map(str, spark.read.format("feed").load(p).where(F.col("seq") > 30).collect())) for p in (source, to)]
    assert both[0] == both[1] and len(both[0]) == 10 and feed.manifest(to)["through"] == 40
