"""Exact n-gram Jaccard self join by rare-first prefix filtering, reduced to its components.

A text's set holds the hashes of its distinct shingles. Texts with equal sets are one *class*, and
only the class's smallest id goes on. Every set is ordered rare-first, by counts that all texts have
contributed to, and only its prefix is posted: two sets with Jaccard similarity t share a shingle
among the first ``n - ceil(t n) + 1`` of either. Lists of postings are joined in steps, so that
a list of very many similar texts does not make all its pairs:

1. *Stars*: each text with the smallest id, the pivot, of one of its lists; then with the pivots of
   its other lists. Verified pairs give components.
2. *Crossings*: all pairs of a list whose ends are still in different components.

Pairs within a component need no check, since only reachability is asked for.

Length and positional filters drop pairs before any set moves; the suffix filter stands before the
full intersection; each pair is verified once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seekstone.graph import connected_components
from seekstone.llm.textvec import SHINGLE_WORDS, Words, bound_batches, chunks, mix, shingle_sets
from seekstone.shared import stage

#: Counters of the shingle counts that order the sets. Their number is fixed, whatever the input's
#: size: a counter is shared by all shingles that fall on it, which may only misplace a shingle in
#: the order, never lose a pair.
COUNTERS = 1 << 20
COUNTER_PIECES = 64
#: A shingle whose counter is so far above the mean may have a long list: its list is dealt in a way
#: that AQE can split.
LONG_LIST = 2000
#: Tables of ids with more rows are joined by a shuffle.
BROADCAST_ROWS = 250_000


def need(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The least intersection of a set of n with any set that it links to: ceil(percent n / 100)."""
    return -((-percent * n) // 100)


def overlap_needed(a: int, b: int, percent: int) -> int:
    """The least intersection i with 100 i >= percent (a + b - i)."""
    return -((-percent * (a + b)) // (100 + percent))


def shingle_counts(documents: DataFrame, size: int) -> np.ndarray:
    """For each counter the number of distinct shingles of all texts that fall on it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for _, _, raw, offsets in chunks(batch.column(0)):
                for found in shingle_sets(Words(raw, offsets), size):
                    # shingles of one text seldom share a counter; those that do count twice
                    np.add.at(total, (found >> np.uint64(44)).astype(np.int64), 1)
        if total.any():
            parts = total.astype("<u4" if total.max() < 2**32 else "<u8").reshape(COUNTER_PIECES, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(COUNTER_PIECES), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array([parts.dtype.itemsize] * COUNTER_PIECES, pa.int32())], names=["piece", "counts", "width"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, counts, width in zip(*(batch.column(k).to_pylist() for k in range(3))):
                sums[piece] = sums.get(piece, 0) + np.frombuffer(counts, f"<u{width}").astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.astype("<u8").tobytes() for s in sums.values()], pa.binary()), pa.array([8] * len(sums), pa.int32())], names=["piece", "counts", "width"])

    schema = "piece int, counts binary, width int"
    parts = documents.select(F.col("text").cast("string")).mapInArrow(count, schema)
    # dealt by piece and a salt first, so that no task gathers a piece from all tasks
    summed = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(16))).repartition("piece", "salt").select("piece", "counts", "width").mapInArrow(add, schema)
    total = np.zeros((COUNTER_PIECES, COUNTERS // COUNTER_PIECES), np.int64)
    for row in summed.repartition("piece").mapInArrow(add, schema).collect():  # COUNTERS * 8 bytes at most
        total[row["piece"]] += np.frombuffer(row["counts"], "<u8").astype(np.int64)
    return total.reshape(-1)


def prefixes(documents: DataFrame, percent: int, size: int, counts) -> DataFrame:
    """``(doc_id, n, sig_a, sig_b, prefix, long)``: set size, digest, prefix in rare-first order,
    and the number of prefix shingles at its end whose lists may be long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = counts.value
        long_from = seen.mean() * 4 + LONG_LIST
        for batch in batches:
            n, sig_a, sig_b, prefix, many = [], [], [], [], []
            for _, _, raw, offsets in chunks(batch.column(1)):
                for found in shingle_sets(Words(raw, offsets), size):
                    weight = seen[(found >> np.uint64(44)).astype(np.int64)]
                    order = np.argsort(weight, kind="stable")[: len(found) - need(len(found), percent) + 1 if len(found) else 0]
                    n.append(len(found))
                    sig_a.append(int(mix(found).sum(dtype=np.uint64).view(np.int64)))
                    sig_b.append(int(mix(found ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64)))
                    prefix.append(found[order].tobytes())
                    many.append(int((weight[order] > long_from).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sig_a, pa.int64()), pa.array(sig_b, pa.int64()), pa.array(prefix, pa.binary()), pa.array(many, pa.int32())], names=["doc_id", "n", "sig_a", "sig_b", "prefix", "long"])

    return documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, n bigint, sig_a bigint, sig_b bigint, prefix binary, long int")


def postings(classes: DataFrame, long: bool) -> DataFrame:
    """``(token, doc, pos)`` of the prefixes: those whose lists may be long, or all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, tails = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            lists = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            pos = [np.arange(len(x) - t, len(x)) if long else np.arange(len(x) - t) for x, t in zip(lists, tails)]
            sizes = [len(p) for p in pos]
            if sum(sizes):
                token = np.concatenate([x[p] for x, p in zip(lists, pos)])
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(np.repeat(docs, sizes)), pa.array(np.concatenate(pos).astype(np.int32))], names=["token", "doc", "pos"])

    chosen = classes.where("long > 0") if long else classes
    return chosen.select("doc", "prefix", "long").mapInArrow(run, "token bigint, doc bigint, pos int")


def lists_of(classes: DataFrame) -> DataFrame:
    """``(token, doc, pos, pivot, pivot_pos)`` of the lists with two texts or more."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by token and doc: the first of each run is its pivot; runs may span batches."""
        held, out = None, None
        for batch in batches:
            token, doc, pos = (batch.column(k).to_numpy() for k in range(3))
            if not len(token):
                continue
            if held is not None:
                token, doc, pos = np.r_[held[0], token], np.r_[held[1], doc], np.r_[held[2], pos]
                carried = held[3]
            else:
                carried = None
            first = np.ones(len(token), bool)
            first[1:] = token[1:] != token[:-1]
            start = np.maximum.accumulate(np.where(first, np.arange(len(token)), 0))
            pivot, pivot_pos = doc[start], pos[start]
            shared = ~first
            shared[:-1] |= ~first[1:]
            if carried is not None and carried[2]:  # the row that was held goes on a run whose pivot is known
                same = start == 0
                pivot, pivot_pos = np.where(same, carried[0], pivot), np.where(same, carried[1], pivot_pos)
                shared |= same
            # the last row waits: whether its run goes on is not known yet
            keep = shared[:-1]
            held = (token[-1:], doc[-1:], pos[-1:], (pivot[-1], pivot_pos[-1], not first[-1] or carried is not None and carried[2] and start[-1] == 0))
            out = [pa.array(x[:-1][keep]) for x in (token, doc, pos, pivot, pivot_pos)]
            if len(out[0]):
                yield pa.RecordBatch.from_arrays(out, names=["token", "doc", "pos", "pivot", "pivot_pos"])
        if held is not None and held[3][2]:
            yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1]), pa.array(held[2]), pa.array([held[3][0]], pa.int64()), pa.array([held[3][1]], pa.int32())], names=["token", "doc", "pos", "pivot", "pivot_pos"])

    short = postings(classes, False).repartition("token").sortWithinPartitions("token", "doc")
    short = short.mapInArrow(runs, "token bigint, doc bigint, pos int, pivot bigint, pivot_pos int")
    tails = postings(classes, True)
    heads = tails.groupBy("token").agg(F.min(F.struct("doc", "pos")).alias("h"), F.count("*").alias("c")).where("c > 1").select("token", F.col("h.doc").alias("pivot"), F.col("h.pos").alias("pivot_pos"))
    return short.unionByName(tails.join(heads, "token").select("token", "doc", "pos", "pivot", "pivot_pos"))


def could_link(a: str, b: str, percent: int, all_shared: bool = False) -> F.Column:
    """Length and positional filters on rows with n and pos of both sides, for a shingle they share.

    Up to a shared shingle a pair may share what stands before it, and from it on what the shorter
    rest holds. If the pair has a row for each shingle that its prefixes share, nothing before the
    first of them is shared; a row that passes for a later one would have passed for the first.
    """
    n_a, n_b, pos_a, pos_b = (F.col(f"{c}_{s}") for c in ("n", "pos") for s in (a, b))
    most = F.least(n_a - pos_a, n_b - pos_b)
    if not all_shared:
        most = most + F.least(pos_a, pos_b)
    return (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)) & ((100 + percent) * most >= percent * (n_a + n_b))


def suffix_bound(a: np.ndarray, b: np.ndarray, depth: int = 2) -> int:
    """An upper bound of the intersection of two sorted sets: split by the middle of one, and again."""
    if depth == 0 or len(a) < 8 or len(b) < 8:
        return min(len(a), len(b))
    middle = a[len(a) // 2]
    i, j = int(np.searchsorted(a, middle)), int(np.searchsorted(b, middle))  # equal hashes stay together
    return suffix_bound(a[:i], b[:j], depth - 1) + suffix_bound(a[i:], b[j:], depth - 1)


def judged(a: np.ndarray, b: np.ndarray, percent: int, exact: bool) -> int:
    """1 if sorted sets link, 0 if not, and 2 if shortened hashes leave it open.

    Two shingles that differ may have the same shortened hash; the more such pairs are to be
    expected, the wider the margin that is left open.
    """
    least = overlap_needed(len(a), len(b), percent)
    if min(len(a), len(b)) < least or suffix_bound(a, b) < least:
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    shared = int((b[at] == a).sum())
    if shared < least:
        return 0
    return 1 if exact or shared >= least + 3 + (4 * len(a) * len(b) >> 32) else 2


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` to be broadcast if it has few enough ``rows``; else Spark chooses, and can split skew."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def set_table(documents: DataFrame, ids: DataFrame, size: int, exact: bool) -> DataFrame:
    """``(doc, shingles)`` with sorted sets of the documents in ``ids(doc)``: of whole hashes, or of
    hashes shortened to 32 bits, which keep their number and halve what travels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = (s for _, _, raw, offsets in chunks(batch.column(1)) for s in shingle_sets(Words(raw, offsets), size))
            found = [(s if exact else (s >> np.uint64(32)).astype(np.uint32)).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["doc", "shingles"])

    chosen = documents.select(F.col("doc_id").alias("doc"), F.col("text").cast("string").alias("text")).join(small(ids, ids.count()), "doc", "left_semi")
    return chosen.mapInArrow(run, "doc bigint, shingles binary")


def verified(pairs: DataFrame, documents: DataFrame, percent: int, size: int, exact: bool = False) -> DataFrame:
    """Those of ``pairs(a, b)`` that link. Pairs that shortened hashes leave open are judged again."""
    kind = np.uint64 if exact else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judged(np.frombuffer(x, kind), np.frombuffer(y, kind), percent, exact) for x, y in zip(*(batch.column(k).to_pylist() for k in (2, 3)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int32())], names=["a", "b", "links"])

    ids = stage(pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc"))).distinct(), "members")
    sets = stage(set_table(documents, ids, size, exact), "sets")
    of = lambda side, name: sets.select(F.col("doc").alias(side), F.col("shingles").alias(name))
    judgement = pairs.join(of("a", "set_a"), "a").join(of("b", "set_b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a bigint, b bigint, links int")
    judgement = stage(judgement.where("links > 0"), "judged")
    sure = judgement.where("links = 1").select("a", "b")
    if exact:
        return sure
    open_ = judgement.where("links = 2").select("a", "b").distinct()
    return sure if open_.isEmpty() else sure.unionByName(verified(open_, documents, percent, size, True))


def jaccard_components(documents: DataFrame, percent: int = 75, size: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of ``documents(doc_id, text)``.

    Two texts link when 100 * intersection >= ``percent`` * union of their sets of ``size``-word
    shingles. ``component_id`` is the smallest ``doc_id`` reachable. Null and empty texts have no
    shingles and link with nothing; texts shorter than ``size`` words are one shingle. Rows with a
    null ``doc_id`` are returned with a null component and link with nothing; a ``doc_id`` that
    repeats is one text for each row, and its rows belong to one component. Other columns are
    ignored, and an empty table gives no rows.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    documents = documents.select("doc_id", "text")
    counts = spark.sparkContext.broadcast(shingle_counts(documents, size))
    table = stage(prefixes(documents, percent, size, counts), "prefixes")
    solid = table.where("doc_id is not null and n > 0")
    first = stage(solid.groupBy("sig_a", "sig_b", "n").agg(F.min("doc_id").alias("doc"), F.count("*").alias("c")).where("c > 1").select("sig_a", "sig_b", "n", "doc"), "classes")
    copies = stage(solid.select("doc_id", "sig_a", "sig_b", "n").join(first, ["sig_a", "sig_b", "n"]).where("doc_id <> doc").select("doc_id", "doc").distinct(), "copies")
    # an id that repeats may belong to several classes: it is posted with each of its sets
    repeated = stage(solid.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id"), "repeated")
    dropped = copies.select("doc_id").join(repeated, "doc_id", "left_anti").distinct()
    lone = solid.join(small(dropped, copies.count()), "doc_id", "left_anti")
    lists = stage(lists_of(lone.select(F.col("doc_id").alias("doc"), "prefix", "long")), "lists")
    sizes = solid.select(F.col("doc_id").alias("doc"), "n").distinct()

    def possible(met: DataFrame) -> DataFrame:
        """Distinct pairs (a, b), also with their components, that pass the length and positional filters."""
        for side in ("a", "b"):
            met = met.join(sizes.select(F.col("doc").alias(side), F.col("n").alias(f"n_{side}")), side)
        return met.where(could_link("a", "b", percent)).groupBy("a", "b").agg(F.first("part_a").alias("part_a"), F.first("part_b").alias("part_b"))

    def with_part(df: DataFrame, column: str, name: str) -> DataFrame:
        """``df`` with the component of a text, itself where it has none yet."""
        labels = parts.select(F.col("node").alias(column), F.col("component").alias(name))
        return df.join(small(labels, n_parts), column, "left").withColumn(name, F.coalesce(name, column))

    def merge(links: DataFrame) -> DataFrame:
        """Components after links between components ``(a, b)``."""
        joined = stage(connected_components(links), "joined").select(F.col("node").alias("component"), F.col("component").alias("whole"))
        wide = parts.join(joined, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
        alone = joined.join(parts.select("component").distinct(), "component", "left_anti")
        return stage(wide.unionByName(alone.select(F.col("component").alias("node"), F.col("whole").alias("component"))), "parts")

    def links_of(pairs: DataFrame) -> DataFrame:
        """Component pairs of the verified among pairs (a, b, part_a, part_b)."""
        found = verified(pairs.select("a", "b"), documents, percent, size)
        return found.join(pairs, ["a", "b"]).select(F.col("part_a").alias("a"), F.col("part_b").alias("b"))

    # each text with the pivot of one list, that of its prefix's commonest shingle
    last = lists.groupBy("doc").agg(F.max(F.struct("pos", "pivot", "pivot_pos")).alias("l"))
    last = last.where("doc <> l.pivot").select(F.col("l.pivot").alias("a"), F.col("doc").alias("b"), F.col("l.pivot_pos").alias("pos_a"), F.col("l.pos").alias("pos_b"))
    stars = stage(possible(last.withColumns({"part_a": F.col("a"), "part_b": F.col("b")})), "stars")
    same_id = copies.join(repeated, "doc_id", "left_semi").select(F.col("doc").alias("a"), F.col("doc_id").alias("b"))
    parts = stage(connected_components(links_of(stars).unionByName(same_id)), "parts")
    n_parts = parts.count()
    # then with the pivots of all its other lists, where these are in other components
    apart = with_part(with_part(lists, "doc", "part_b"), "pivot", "part_a").where("part_a <> part_b")
    met = apart.groupBy(F.col("pivot").alias("a"), F.col("doc").alias("b")).agg(F.min(F.struct("pos", "pivot_pos", "part_a", "part_b")).alias("m")).select("a", "b", F.col("m.pos").alias("pos_b"), F.col("m.pivot_pos").alias("pos_a"), "m.part_a", "m.part_b")
    met = stage(possible(met).join(stars.select("a", "b"), ["a", "b"], "left_anti"), "met")
    if not met.isEmpty():
        parts = merge(links_of(met))
        n_parts = parts.count()
    # and all pairs across the components that are left in a list
    labelled = with_part(with_part(lists, "doc", "part_b"), "pivot", "part_a")
    tokens = stage(labelled.where("part_a <> part_b").select("token").distinct(), "tokens")
    left = lists.select("token", "doc", "pos").join(small(tokens, tokens.count()), "token", "left_semi").join(sizes, "doc")
    left = stage(with_part(left, "doc", "part"), "crossing-lists")
    # only sets of about the same size can link: those of one band of sizes, or of the next
    x, y = (left.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("pos", "n", "part")), F.col("doc").alias(s), F.floor(F.log(F.col("n").cast("double")) / np.log(100 / percent)).cast("int").alias("band")) for s in "ab")
    y = y.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    crossing = x.join(y, ["token", "band"]).where("a < b and part_a <> part_b").where(could_link("a", "b", percent, True))
    crossing = crossing.groupBy("a", "b").agg(F.first("part_a").alias("part_a"), F.first("part_b").alias("part_b"))
    seen = stars.select("a", "b").unionByName(met.select("a", "b"))
    crossing = stage(crossing.join(seen, ["a", "b"], "left_anti"), "crossings")
    if not crossing.isEmpty():
        parts = merge(links_of(crossing))
    components = parts
    return (
        table.select("doc_id", F.col("n").alias("n_shingles"))
        .join(copies.groupBy("doc_id").agg(F.min("doc").alias("class")), "doc_id", "left")
        .withColumn("class", F.coalesce("class", "doc_id"))
        .join(components.select(F.col("node").alias("class"), "component"), "class", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "class").alias("component_id"))
    )


def one_of_each(documents: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of ``documents`` without those that link, directly or not, to a smaller ``doc_id``.

    Rows with a null ``doc_id`` stay. Where several rows have one ``doc_id``, each of their different
    texts counts by itself: the first by hash under the id, the others behind all ids. Of rows with
    the same id and text one stays. Empty texts resemble nothing and stay; an empty table gives none.
    """
    text = F.coalesce(documents["text"].cast("string"), F.lit(""))
    twice = stage(documents.groupBy("doc_id").agg(F.count("*").alias("c"), F.min(F.xxhash64(text)).alias("first")).where("c > 1 and doc_id is not null").select("doc_id", "first"), "twice")
    if twice.isEmpty():
        found = jaccard_components(documents, percent)
        others = found.where("component_id <> doc_id").select("doc_id").distinct()
        return documents.join(others, "doc_id", "left_anti").select(*documents.columns)
    row = F.struct(*(documents[c].alias(c) for c in documents.columns)).alias("row")
    marked = documents.select(row, documents["doc_id"].alias("id"), text.alias("text")).join(twice.withColumnRenamed("doc_id", "t"), F.col("id") == F.col("t"), "left")
    beyond = F.xxhash64("id", "text").bitwiseAND(2**62 - 1).bitwiseOR(2**62)
    key = F.when(F.col("t").isNull() | (F.xxhash64("text") == F.col("first")), F.col("id")).otherwise(beyond)
    marked = stage(marked.select("row", key.alias("doc_id"), "text", F.col("t").isNotNull().alias("again")), "marked")
    others = jaccard_components(marked.where("not again").select("doc_id", "text").unionByName(marked.where("again").select("doc_id", "text").distinct()), percent)
    others = others.where("component_id <> doc_id").select("doc_id").distinct()
    kept = marked.join(others, "doc_id", "left_anti")
    single, again = kept.where("not again").select("row"), kept.where("again").groupBy("doc_id").agg(F.first("row").alias("row")).select("row")
    return single.unionByName(again).select(*(F.col("row")[c].alias(c) for c in documents.columns))
