"""The stored index: updates, removal, compaction, pruned reading, kept hits."""

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from seekstone.operators import index as I, search as S
from seekstone.shared import new_folder

WORDS = ["visual", "studio", "code", "chrome", "note", "pad", "微信", "e", "x2", "PowerPoint", "system", "restore"]
SCHEMA = "id long, name string, display_name string, search_keywords array<string>"
ASKED = ["visual", "vs", "code st", "chrme", "note pad", "微", "e", "", "restroe", "pwr", "xyzzy", "VISUAL"]


def rows_of(rng, ids):
    return [(i, " ".join(rng.choices(WORDS, k=rng.randint(1, 3))), rng.choice([None, "Shown"]), rng.choice([None, [rng.choice(WORDS)]])) for i in ids]


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(list(enumerate(ASKED)), "query_id int, text string")


def found(df):
    return sorted(map(tuple, df.collect()))


def test_index_follows_updates(spark, queries):
    rng = random.Random(5)
    rows = {r[0]: r for r in rows_of(rng, range(60))} | {60: (60, None, None, None)}
    frame = lambda x: spark.createDataFrame(list(x), SCHEMA)
    index = I.build(frame(rows.values()), new_folder(spark, "test-index"), parts=8)
    assert found(I.search(index, queries)) == found(S.search(frame(rows.values()), queries))
    first, before = index, found(I.search(index, queries))
    folder = Path(index.segments[0].removeprefix("file://"))
    stamps = {p: p.stat().st_mtime_ns for p in folder.rglob("*")}
    changed = rows_of(rng, [3, 4, 5, 70, 71])
    index = I.update(index, frame(changed), spark.createDataFrame([(7,), (8,), (999,)], "id long"))
    rows = {k: r for k, r in (rows | {r[0]: r for r in changed}).items() if k not in (7, 8)}
    assert found(I.search(index, queries)) == found(S.search(frame(rows.values()), queries))
    # nothing written before is touched; the new segment holds the changed rows alone
    assert {p: p.stat().st_mtime_ns for p in folder.rglob("*")} == stamps
    assert spark.read.parquet(f"{index.segments[1]}/postings").select("id").distinct().count() == 5
    assert found(I.search(first, queries)) == before  # a reader of the old generation
    index = I.update(index, frame(rows_of(rng, [3, 7])))  # changed again, and back again
    latest = index.rows().select("id", "name", "display_name", "search_keywords").collect()
    assert sorted(r["id"] for r in latest) == sorted({*rows, 7})
    packed = I.compact(index)
    assert len(packed.segments) == 1 and packed.version == 4 and I.opened(spark, index.home) == packed
    want = found(S.search(frame(latest), queries))
    assert found(I.search(packed, queries)) == want == found(I.search(index, queries))


def test_index_reads_the_folders_of_its_keys(spark, queries):
    index = I.build(spark.createDataFrame(rows_of(random.Random(1), range(40)), SCHEMA), new_folder(spark, "test-index"), parts=32)
    asked = S.query_keys(S.parse(spark.createDataFrame([(0, "xq")], "query_id int, text string")), fuzzy=False)
    held = index.postings(asked)
    plan = held._jdf.queryExecution().executedPlan().toString()
    keys = [r["key"] for r in asked.select("key").distinct().collect()]
    parts = sorted({r["p"] for r in asked.select(I.part_of(F.col("key"), 32).alias("p")).collect()})
    filters = re.search(r"PartitionFilters: \[([^\]]*)\]", plan)[1]
    assert len(parts) <= len(keys) < 32 and all(str(p) in re.findall(r"\b\d+\b", re.sub(r"#\d+", "", filters)) for p in parts)
    assert held.count() == 0


def test_index_of_nothing(spark, queries):
    with pytest.raises(FileNotFoundError):
        I.opened(spark, new_folder(spark, "none"))
    empty = spark.createDataFrame([], SCHEMA)
    index = I.build(empty, new_folder(spark, "test-index"))
    assert I.search(index, queries).count() == 0
    index = I.update(index, spark.createDataFrame([(1, "visual", None, None)], SCHEMA))
    assert found(I.search(index, queries)) == found(S.search(spark.createDataFrame([(1, "visual", None, None)], SCHEMA), queries))


def test_kept_hits_are_scored_once(spark, queries, monkeypatch):
    rows = rows_of(random.Random(2), range(30))
    index = I.build(spark.createDataFrame(rows, SCHEMA), new_folder(spark, "test-index"), parts=8)
    asked, score = [], I.hits
    monkeypatch.setattr(I, "hits", lambda *a, **k: asked.append({r["q"] for r in a[1].collect()}) or score(*a, **k))
    ranked = lambda df: found(S.rank(df).select("query_id", "rank", "id", "name", "score", "tag", "tier"))
    want = found(S.search(spark.createDataFrame(rows, SCHEMA), queries.where("text <> ''")))
    assert ranked(I.kept_hits(index, queries)) == want
    assert ranked(I.kept_hits(index, queries)) == want and len(asked) == 1
    more = spark.createDataFrame([(0, "visual"), (1, "new one"), (2, "xyzzy")], "query_id int, text string")
    I.kept_hits(index, more)
    assert len(asked) == 2 and asked[1] == {"new one"}
    newer = I.update(index, spark.createDataFrame([(99, "visual", None, None)], SCHEMA))
    got = I.kept_hits(newer, queries).where("id = 99")
    assert len(asked) == 3 and got.count() > 0  # a new generation begins without any
