"""Ranges of folders, paths by pointer doubling, running sums and as-of marks, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from seekstone.operators import files, ordered
from seekstone.streaming import overlay

NAMES = ["a", "A b", "a.b", "b", "a-b", "é", "aa", "b c"]


def random_paths(rng, n):
    return sorted({"C:\\" + "\\".join(rng.choices(NAMES, k=rng.randint(1, 5))) for _ in range(n)})


def lies_in(path, folder):
    p, f = path.lower(), folder.lower().rstrip("\\")
    return p == f or p.startswith(f + "\\")


@pytest.mark.parametrize("few", [64, 0])
def test_folder_ranges_equal_prefix_tests(spark, few, monkeypatch):
    rng = random.Random(few + 1)
    paths = random_paths(rng, 150)
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(paths)] + [(900 + i, paths[3]) for i in range(5)], "id int, path string")
    folders = rng.sample(random_paths(rng, 60), 14) + ["C:\\none", "c:\\A B"]
    keyed = spark.createDataFrame([(f,) for f in folders], "f string").select(files.order_key(F.col("f")).alias("key"), F.col("f").alias("value")).groupBy("key").agg(F.min("value").alias("value"))
    key = files.order_key(F.col("path"))
    got = {r["id"] for r in files.within(rows, key, keyed, few).collect()}
    every = [(r["id"], r["path"]) for r in rows.collect()]
    assert got == {i for i, p in every if any(lies_in(p, f) for f in folders)}
    best = {r["id"]: r["m"] for r in files.innermost(rows, key, keyed, "m", few).collect()}
    for i, p in every:
        holding = [f for f in folders if lies_in(p, f)]
        assert (best[i] is None) == (not holding) and (not holding or best[i].lower() == max(holding, key=len).lower())
    plan = files.within(rows, key, keyed, few)._jdf.queryExecution().executedPlan().toString()
    assert "explode" not in plan.lower()
    monkeypatch.setattr(files, "FEW", few)
    moves = spark.createDataFrame([("C:\\a", "D:\\x"), ("C:\\a\\b", "E:"), ("c:\\a\\B\\aa", "F:\\y\\z")], "base string, now string")
    for r in files.renamed(rows, moves).collect():
        base = max((b for b in ("C:\\a", "C:\\a\\b", "C:\\a\\B\\aa") if lies_in(r["path"], b)), key=len, default=None)
        want = r["path"] if base is None else {"C:\\a": "D:\\x", "C:\\a\\b": "E:", "C:\\a\\B\\aa": "F:\\y\\z"}[base] + r["path"][len(base):]
        assert r["current"] == want
    left = files.outside(rows.unionByName(spark.createDataFrame([(-1, None)], "id int, path string")), spark.createDataFrame([(f,) for f in folders] + [(None,)], "folder string"))
    assert {r["id"] for r in left.collect()} == {-1} | {i for i, p in every if not any(lies_in(p, f) for f in folders)}


def test_running_sums_and_marks(spark):
    rng = random.Random(8)
    rows = [(rng.randint(0, 50), i, rng.randint(0, 9)) for i in range(300)]
    frame = spark.createDataFrame(rows, "k int, i int, w long").repartition(5)
    got = {r["i"]: r["s"] for r in ordered.running_sum(frame, ["k", "i"], F.col("w"), "s").collect()}
    total = 0
    for _, i, w in sorted(rows):
        total += w
        assert got[i] == total
    assert [r["n"] for r in ordered.numbered(frame, ["k", "i"], "n").orderBy("k", "i").collect()] == list(range(1, 301))
    marks = {5: "five", 20: None, 21: "x", 44: "y"}
    found = ordered.last_before(frame, "k", spark.createDataFrame(list(marks.items()), "key int, value string"), "m")
    for r in found.collect():
        before = [m for m in marks if m <= r["k"]]
        assert r["m"] == (marks[max(before)] if before else None)
    assert found.count() == 300 and ordered.running_sum(frame.limit(0), ["k", "i"], F.col("w"), "s").count() == 0


def test_paths_by_doubling(spark, monkeypatch):
    rng = random.Random(3)
    nodes = [(0, None, "C:", True)] + [(i, rng.randrange(i), f"n{i}", True) for i in range(1, 200)]
    nodes += [(300, 7, "hard link", False), (300, 8, "hard link too", False), (400, 401, "x", True), (401, 400, "y", True), (402, 401, "below a cycle", False), (500, 999, "lost", True), (501, 500, "below", False)]
    frame = spark.createDataFrame(nodes, "frn long, parent_frn long, name string, is_dir boolean")

    def paths(frn, seen=()):
        out = []
        for f, up, name, _ in nodes:
            if f == frn and f not in seen:
                out += [name] if up is None else [f"{p}\\{name}" for p in paths(up, (*seen, f))]
        return out

    want = sorted((f, p) for f in {n[0] for n in nodes} for p in paths(f))
    assert sorted(map(tuple, files.tree_paths(frame).collect())) == want
    faults = dict(map(tuple, files.tree_faults(frame).collect()))
    assert faults == {400: "cycle", 401: "cycle", 402: "cycle", 500: "missing-parent"}
    stated = spark.createDataFrame([(7, "Z:\\own"), (401, "Y:\\cut")], "frn long, path string")
    got = {(r["frn"], r["path"]) for r in files.tree_paths(frame, overrides=stated).collect()}
    assert {(7, "Z:\\own"), (300, "Z:\\own\\hard link"), (402, "Y:\\cut\\below a cycle"), (400, "Y:\\cut\\x")} <= got
    assert files.tree_paths(frame.limit(0)).count() == 0
    rounds, stage = [], files.stage
    monkeypatch.setattr(files, "stage", lambda df, name: rounds.append(name) or stage(df, name))
    chain = spark.range(5000).select(F.col("id").alias("frn"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_frn"), F.lit("f").alias("name"))
    assert files.tree_paths(chain).where("frn = 4999 and path = repeat('f\\\\', 4999) || 'f'").count() == 1
    assert rounds.count("tree-paths") - 1 <= 14
    with pytest.raises(RuntimeError, match="deeper"):
        files.tree_paths(chain, max_depth=100)


def test_rounds_of_folder_changes_equal_plain_replay(spark):
    """Random rounds of renames and deletions, replayed path by path."""
    rng = random.Random(6)
    folders = {1: ["C:\\d1"], 2: ["C:\\d1\\d2"], 3: ["C:\\d3"], 4: ["C:\\d1\\d2\\d4"], 5: ["C:\\d5 x"]}
    files_ = {100 + i: [f"{rng.choice(list(folders.values()))[0]}\\f{i}"] for i in range(25)}
    held = [(k, True, p[0]) for k, p in folders.items()] + [(k, False, p[0]) for k, p in files_.items()]
    base = spark.createDataFrame([(i, "v", k, d, p) for i, (k, d, p) in enumerate(held)], "ordinal long, volume string, frn long, is_dir boolean, path string")
    world, state = {k: (d, p) for k, d, p in held}, overlay.empty_state(spark)
    for _ in range(4):
        changes = []
        for n, k in enumerate(rng.sample(sorted(k for k, (d, _) in world.items() if d), min(2, sum(d for d, _ in world.values())))):
            if k not in world:
                continue
            old = world[k][1]
            new = None if rng.random() < 0.4 else f"C:\\m{rng.randint(0, 99)}-{k}"
            changes.append((n, "v", k, True, [new] if new else [], False))
            for other, (d, p) in list(world.items()):
                if lies_in(p, old):
                    if new:
                        world[other] = (d, new + p[len(old):])
                    else:
                        del world[other]
        frame = spark.createDataFrame(changes, "ordinal long, volume string, frn long, is_dir boolean, paths array<string>, identity_only boolean")
        state = overlay.apply_round(base, state, frame)
        assert {(r["frn"], r["path"]) for r in overlay.view(base, state).collect()} == {(k, p) for k, (_, p) in world.items()}
