"""Folder changes of a round: a path meets those it lies in, and no list of all."""

import random

import pytest
from pyspark.sql import functions as F

from seekstone.plans import catalog_queries
from seekstone.streaming import overlay

NAMES = ["a", "A", "b", "c d", "é", ""]
OPS = f"volume string, ops {overlay.OPS}"


def some_path(rng, most):
    return "\\".join(rng.choices(NAMES, k=rng.randint(1, most)))


def replayed(path, ops):
    for old, new in ops:
        if path.lower() == old.lower() or path.lower().startswith(old.lower() + "\\"):
            if new is None:
                return None
            path = new + path[len(old) :]
    return path


@pytest.mark.parametrize("most,rounds", [(10_000, 32), (0, 32), (10_000, 1)])
def test_paths_after_changes_equal_plain_replay(spark, monkeypatch, most, rounds):
    monkeypatch.setattr(overlay, "BROADCAST_CHANGES", most)
    monkeypatch.setattr(overlay, "ROUNDS", rounds)
    rng = random.Random(12)
    ops = {v: [(some_path(rng, 2), some_path(rng, 3) if rng.random() < 0.8 else None) for _ in range(12)] for v in "vw"}
    paths = sorted({(v, some_path(rng, 4)) for v in "vwx" for _ in range(80)})
    frame = spark.createDataFrame([*paths, ("v", None), *paths[:5]], "volume string, path string")
    got = {(r["volume"], r["path"]): r["now"] for r in overlay.moves(frame, spark.createDataFrame(list(ops.items()), OPS)).collect()}
    want = {(v, p): replayed(p, ops.get(v, [])) for v, p in paths}
    assert len(got) > 80 and {k: got.get(k, k[1]) for k in want} == want and set(got) <= set(want)


def test_base_rows_do_not_go_over_all_changes(spark, monkeypatch):
    """Before, each row of the base below a changed folder went over the whole round's changes."""
    seen, plain = [], overlay.folded
    monkeypatch.setattr(overlay, "folded", lambda path, ops: seen.append(path) or plain(path, ops))
    n = 40
    rows = [(k, "v", k, True, f"d{k}") for k in range(n)] + [(n + k, "v", n + k, False, f"d{k}\\f") for k in range(n)]
    base = spark.createDataFrame(rows, "ordinal long, volume string, frn long, is_dir boolean, path string")
    changes = spark.createDataFrame([(k, "v", k, True, [] if k % 2 else [f"x{k}"], False) for k in range(n)], "ordinal long, volume string, frn long, is_dir boolean, paths array<string>, identity_only boolean")
    state = overlay.apply_round(base, overlay.empty_state(spark), changes)
    assert {r["path"] for r in overlay.view(base, state).collect()} == {f"x{k}{end}" for k in range(0, n, 2) for end in ("", "\\f")}
    assert set(seen) == {"x"}  # only a round's folders are placed one after another


def test_frames_are_numbered_by_ranges(spark):
    """Before, one task numbered all frames."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        _, frames = catalog_queries.changed_hosts(spark, "/root/testdata/sf0.01")
        assert frames.groupBy(F.spark_partition_id()).agg(F.max("seq").alias("last")).where("last > 0").count() > 1
        got = [(r["seq"], r["round"], r["kind"] == "round_commit") for r in frames.orderBy("seq").collect()]
    finally:
        spark.conf.unset(name)
    assert [x[0] for x in got] == list(range(1, len(got) + 1)) and [x[1:] for x in got] == sorted(x[1:] for x in got)
