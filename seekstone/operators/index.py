"""A search index that is written once and kept: postings by key, rows by id, in published generations.

A generation is a list of segments. A segment holds the distinct texts of its rows, enriched, the rows
themselves, postings ``(key, id)`` of the texts dealt into folders by a hash of the key and sorted by
key, and the ids whose rows in earlier segments no longer count. A batch of queries reads the folders of its own keys only. An update writes one more
segment with the keys of the changed rows and nothing else; ``compact`` makes one segment of all.
Readers see a generation only when the pointer names it, so a search that runs goes on with its own.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seekstone.operators import search as S
from seekstone.shared import stage
from seekstone.sources.sinks import move_pointer, pointed

#: All kinds of keys that a query may ask for.
KINDS = {"g1", "g2", "g3", "k1", "k2", "k3", "x", "y", "a", "i", "h", "d", "s"}
#: Folders of postings, and how many files a folder's rows are dealt over.
PARTS, SPREAD = 64, 4
#: Lists of superseded ids of more rows are joined by a shuffle.
BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class Index:
    """A generation as a search sees it: its segments' folders, oldest first, and its number."""

    spark: SparkSession
    home: str
    version: int
    segments: tuple[str, ...]
    parts: int

    def read(self, name: str) -> DataFrame:
        """A table of all segments with the segment's place, ``_segment``."""
        out = None
        for n, folder in enumerate(self.segments):
            reader = self.spark.read
            if name == "postings":  # a table without rows has no file that says its columns
                reader = reader.schema("key string, id string, part int")
            rows = reader.parquet(f"{folder}/{name}").withColumn("_segment", F.lit(n))
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out

    def living(self, rows: DataFrame) -> DataFrame:
        """``rows(id, _segment)`` that no later segment supersedes."""
        if len(self.segments) == 1:
            return rows
        gone = self.read("gone").groupBy(F.col("id").alias("_gone")).agg(F.max("_segment").alias("_since"))
        gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
        return rows.join(gone, (F.col("id") == F.col("_gone")) & (F.col("_segment") < F.col("_since")), "left_anti")

    def members(self) -> DataFrame:
        """Living rows without their texts, with ``text_id``."""
        return self.living(self.read("members")).drop("_segment")

    def texts(self) -> DataFrame:
        """The texts of all segments, each once; some may have no living row."""
        return self.read("texts").drop("_segment").dropDuplicates(["text_id"])

    def rows(self) -> DataFrame:
        return self.members().join(self.texts().drop("id"), "text_id").drop("text_id")

    def postings(self, keys: DataFrame) -> DataFrame:
        """``(key, id)`` of ``keys(key)`` by texts: only their folders are read."""
        of = part_of(F.col("key"), self.parts)
        wanted = [r["part"] for r in keys.select(of.alias("part")).distinct().orderBy("part").collect()]  # ``parts`` at most
        held = self.read("postings").where(F.col("part").isin(wanted))
        return held.join(keys.select("key").distinct(), "key", "left_semi").select("key", "id").distinct()


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def write_segment(rows: DataFrame, gone: DataFrame, home: str, parts: int) -> str:
    """A segment of a catalog's ``rows`` and the ids that it supersedes; its folder."""
    folder = f"{home}/segment-{uuid.uuid4().hex}"
    texts, members = S.by_text(rows)
    texts.write.parquet(f"{folder}/texts")
    texts = rows.sparkSession.read.schema(texts.schema).parquet(f"{folder}/texts")
    members.select("text_id", *(c for c in rows.columns if c not in texts.columns or c == "id")).write.parquet(f"{folder}/members")
    keys = S.spread(texts).select("id", F.explode(S.doc_keys(texts, KINDS)).alias("key")).withColumn("part", part_of(F.col("key"), parts))
    # a key that most rows hold is dealt over several files of its folder
    dealt = keys.repartition("part", F.pmod(F.xxhash64("id"), F.lit(SPREAD))).sortWithinPartitions("part", "key", "id")
    dealt.write.partitionBy("part").parquet(f"{folder}/postings")
    gone.select("id").distinct().write.parquet(f"{folder}/gone")
    return folder


def _publish(spark: SparkSession, home: str, version: int, segments: list[str], parts: int) -> Index:
    move_pointer(spark, home, {"version": version, "segments": [s.rpartition("/")[2] for s in segments], "parts": parts})
    return Index(spark, home, version, tuple(segments), parts)


def build(catalog: DataFrame, home: str, parts: int = PARTS) -> Index:
    """The first generation (or a new one that replaces all) of ``catalog`` in the folder ``home``."""
    spark = catalog.sparkSession
    before = pointed(spark, home)
    folder = write_segment(catalog, catalog.select("id").limit(0), home, parts)
    return _publish(spark, home, before["version"] + 1 if before else 1, [folder], parts)


def opened(spark: SparkSession, home: str) -> Index:
    """The generation that the pointer names; an error before the first."""
    now = pointed(spark, home)
    if now is None:
        raise FileNotFoundError(f"no index in {home}")
    return Index(spark, home, now["version"], tuple(f"{home}/{s}" for s in now["segments"]), now["parts"])


def update(index: Index, changed: DataFrame, removed: DataFrame | None = None) -> Index:
    """The next generation: rows of ``changed`` (a catalog's columns) replace those of the same ids or are
    new, ids of ``removed(id)`` go. Only changed rows are keyed; no earlier file is written again."""
    ids = changed.select("id")
    gone = ids if removed is None else ids.unionByName(removed.select("id"))
    folder = write_segment(changed, gone, index.home, index.parts)
    return _publish(index.spark, index.home, index.version + 1, [*index.segments, folder], index.parts)


def compact(index: Index) -> Index:
    """The same rows as one segment."""
    rows = stage(index.rows().drop(*S.DERIVED), "rows")
    folder = write_segment(rows, rows.select("id").limit(0), index.home, index.parts)
    return _publish(index.spark, index.home, index.version + 1, [folder], index.parts)


def recall(index: Index, parsed: DataFrame, fuzzy: bool = True, aliases: DataFrame | None = None) -> DataFrame:
    """``(query_id, id)`` of texts as ``search.recall`` finds them, from stored postings."""
    asked = stage(S.query_keys(parsed, fuzzy, aliases), "asked")
    return S.followed_ids(asked, stage(index.postings(asked), "held-keys"), asked.count())


def hits(index: Index, parsed: DataFrame, fuzzy: bool = True, aliases: DataFrame | None = None, by_row: bool = True) -> DataFrame:
    """All scored hits of parsed queries, with evidence; without ``by_row`` those of the texts, each once
    with its ``text_id`` (aliases go by rows)."""
    if aliases is not None and not by_row:
        raise ValueError("aliases name rows")
    members, own = index.members(), None
    if aliases is not None:
        # rows that an alias names by their id are texts of their own, which no stored posting knows
        ids = aliases.where("target_id is not null").select(F.col("target_id").cast("string").alias("_named")).distinct()
        named = F.col("id").cast("string") == F.col("_named")
        own = S.hits(index.rows().join(ids, named, "left_semi").drop(*S.DERIVED), parsed, fuzzy=fuzzy, aliases=aliases)
        members = members.join(ids, named, "left_anti")
    met = stage(recall(index, parsed, fuzzy, aliases), "met")
    texts = index.texts().join(met.select("id").distinct(), "id", "left_semi")
    joined = met.join(texts, "id").join(S.small(parsed, parsed.count()), "query_id")
    scored = S.verify(S.spread(S.with_aliases(joined, aliases)), fuzzy)
    if not by_row:
        return scored
    found = S.of_rows(scored, members)
    return found if own is None else found.unionByName(own, allowMissingColumns=True)


def search(index: Index, queries: DataFrame, k: int = S.TOP_K, fuzzy: bool = True, aliases: DataFrame | None = None) -> DataFrame:
    """What ``search.search`` gives over the index's rows, read from the index."""
    parsed = S.parse(queries)
    return S.with_empty(S.rank(hits(index, parsed, fuzzy, aliases), k), index.rows(), parsed, k)


# --- base hits kept by generation ----------------------------------------------------------------

KEPT = ["q", "id", "name", "score", "tag", "tier", "start", "gaps", "edits", "span", "field", "kind"]
#: What is stored of a text's hit.
STORED = ["text_id" if c == "id" else c for c in KEPT]


def kept_hits(index: Index, queries: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Base hits of ``queries(query_id, text)``: each distinct normalized query is scored once in a
    generation; later batches read what is stored.

    Hits of texts are stored, all of them, for preferences may lift any, in a folder of the generation's
    own number: a new generation begins without any. A generation's rows do not change, so readers join
    them to what is stored of their texts. Preferences that change are applied to that
    (``preferences.personalize``, ``ranking.finish``) and score nothing again. Two batches that store one
    query at once store the same hits, and readers take each once.
    """
    spark, home = index.spark, f"{index.home}/hits-{index.version}-{int(fuzzy)}"
    parsed = S.parse(queries)
    wanted = stage(parsed.where("q <> ''").select("q", "c", "q_tokens", "q_parts").dropDuplicates(["q"]), "wanted")
    known = _known(spark, home)
    fresh = wanted if known is None else stage(wanted.join(known.select("q"), "q", "left_anti"), "fresh")
    if not fresh.isEmpty():
        asking = fresh.select(F.xxhash64("q").alias("query_id"), "q", "c", "q_tokens", "q_parts")
        found = hits(index, asking, fuzzy, by_row=False).select(*STORED)
        # queries without hits are known as well; one with very many is dealt over several tasks
        whole = fresh.select("q").join(found, "q", "left")
        whole.withColumn("at", F.pmod(F.xxhash64("q"), F.lit(16))).hint("rebalance", "at").write.partitionBy("at").mode("append").parquet(home)
    stored = spark.read.parquet(home).where("text_id is not null").select(*STORED)
    asked = parsed.select("query_id", "q").join(stored.distinct(), "q")
    return index.members().select("text_id", "id").join(S.small(asked, stored.count()), "text_id").select("query_id", *KEPT)


def _known(spark: SparkSession, home: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{home}/_SUCCESS")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.parquet(home).select("q").distinct()
