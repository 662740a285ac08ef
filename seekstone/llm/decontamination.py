"""Benchmark decontamination by SimHash of item-sized windows, as DataFrame functions only.

A benchmark item of w words is compared with windows of w words of a document. Both sides get a
64-bit SimHash of their weighted shingles. Fingerprints meet through a multi-index: they are cut
into blocks, and an item is entered under every block value within ``radius // blocks`` bits of its
own, so that by the pigeonhole principle every window within ``radius`` bits shares an entry with
it. Candidates within the radius are then verified by the exact weighted similarity.

A window that shares no shingle with any item is similar to none. So the only windows that are
fingerprinted are those that a shared shingle aligns with an item: they start where the item would
start, and are as long as it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from seekstone.llm.textvec import SHINGLE_WORDS
from seekstone.shared import stage

SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS = 64


@dataclass(frozen=True)
class Limits:
    """Similarity that counts as a leak, the Hamming search, and the largest tables to broadcast."""

    similarity: float = 0.75
    blocks: int = 4
    radius: int = 19
    broadcast_rows: int = 500_000


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; null has none."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.filter(F.split(low, SPACES), lambda w: w != "")


def shingles_sql(words: str, size: int) -> str:
    """Hashes of all runs of ``size`` words of an SQL array expression, in order."""
    at = ", ".join(f"{words}[i + {k}]" for k in range(size))
    return f"CASE WHEN size({words}) >= {size} THEN transform(sequence(0, size({words}) - {size}), i -> xxhash64({at}, {size})) ELSE CAST(array() AS array<bigint>) END"


def simhash_sql(shingles: str) -> str:
    """SimHash of a bag of hashes: each occurrence votes, so a shingle's weight is its count."""
    return f"""aggregate(transform(sequence(0, {BITS - 1}), b -> CASE WHEN aggregate({shingles}, 0, (s, h) -> s + CASE WHEN getbit(h, b) = 1 THEN 1 ELSE -1 END) > 0
      THEN shiftleft(1L, b) ELSE 0L END), 0L, (u, v) -> u | v)"""


def bag_sql(shingles: str) -> str:
    """A bag of hashes as a set of as many: the second, third, ... occurrence of a hash becomes another
    hash, so that a set's intersection counts the lesser of both counts."""
    numbered = f"""aggregate(array_sort({shingles}), CAST(struct(0L AS held, 0 AS k, array() AS out) AS struct<held:bigint,k:int,out:array<bigint>>),
      (s, h) -> CASE WHEN size(s.out) > 0 AND s.held = h THEN struct(h AS held, s.k + 1 AS k, array_append(s.out, xxhash64(h, s.k + 1)) AS out)
        ELSE struct(h AS held, 0 AS k, array_append(s.out, h) AS out) END, s -> s.out)"""
    return f"CASE WHEN size(array_distinct({shingles})) = size({shingles}) THEN {shingles} ELSE {numbered} END"


def weighted_jaccard_sql(a: str, b: str) -> str:
    """Sum of the lesser over sum of the greater counts of all shingles of two bags (``bag_sql``)."""
    return f"transform(array(size(array_intersect({a}, {b}))), c -> CAST(c AS DOUBLE) / (size({a}) + size({b}) - c))[0]"


def item_table(benchmark: DataFrame) -> DataFrame:
    """``(item_id, n_words, size, grams, fingerprint, bag)``; items without words are left out."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("w")).where("item_id is not null and size(w) > 0")
    items = items.withColumn("size", F.least(F.size("w"), F.lit(SHINGLE_WORDS)))
    grams = "CASE size " + " ".join(f"WHEN {k} THEN {shingles_sql('w', k)}" for k in range(1, SHINGLE_WORDS + 1)) + " END"
    items = items.select("item_id", F.size("w").alias("n_words"), "size", F.expr(grams).alias("grams"))
    return items.withColumns({"fingerprint": F.expr(simhash_sql("grams")), "bag": F.expr(bag_sql("grams"))})


def small(df: DataFrame, rows: int, most: int) -> DataFrame:
    """``df`` to be broadcast if it has at most ``most`` rows; else Spark chooses, and can split skew."""
    return F.broadcast(df) if rows <= most else df


def seeds(documents: DataFrame, items: DataFrame, limits: Limits) -> DataFrame:
    """``(doc_id, row, start, n_words)``: distinct windows that a shared shingle aligns with an item."""
    entries = stage(items.select("n_words", "size", F.posexplode("grams").alias("at", "gram")).distinct(), "item-shingles")
    sizes = [r["size"] for r in entries.select("size").distinct().collect()] or [SHINGLE_WORDS]  # five at most
    keys = entries.select("gram").distinct()
    n_keys, n_entries = keys.count(), entries.count()
    words = documents.select("doc_id", "row", words_of(F.col("text")).alias("w"))
    hits = None
    for size in sizes:
        grams = words.select("doc_id", "row", F.size("w").alias("n"), F.posexplode(F.expr(shingles_sql("w", size))).alias("pos", "gram"))
        grams = grams.join(small(keys, n_keys, limits.broadcast_rows), "gram", "left_semi")
        hits = grams if hits is None else hits.unionByName(grams)
    aligned = hits.join(small(entries, n_entries, limits.broadcast_rows), "gram")
    start = F.greatest(F.lit(0), F.least(F.col("pos") - F.col("at"), F.col("n") - F.col("n_words")))
    return aligned.select("doc_id", "row", start.alias("start"), "n_words", "size").distinct()


def windows(documents: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` windows with the bag of shingles and the fingerprint of each."""
    words = documents.select("doc_id", "row", words_of(F.col("text")).alias("w"))
    whole = words.join(found.withColumnsRenamed({"doc_id": "id"}), "row").where(F.col("id").eqNullSafe(F.col("doc_id"))).drop("id")
    whole = whole.withColumn("w", F.expr("slice(w, start + 1, n_words)"))
    grams = "CASE least(size, size(w)) " + " ".join(f"WHEN {k} THEN {shingles_sql('w', k)}" for k in range(1, SHINGLE_WORDS + 1)) + " END"
    whole = whole.select("doc_id", "row", "start", "n_words", F.expr(grams).alias("grams"))
    return whole.select("doc_id", "row", "start", "n_words", F.expr(simhash_sql("grams")).alias("fingerprint"), F.expr(bag_sql("grams")).alias("bag"))


def neighbours(bits: int, most: int) -> list[int]:
    """All masks of ``bits`` bits with at most ``most`` set."""
    masks, level = [0], [0]
    for _ in range(most):
        level = sorted({m | 1 << b for m in level for b in range(bits) if not m >> b & 1})
        masks += level
    return masks


def block_sql(fingerprint: str, k: int, width: int) -> str:
    return f"CAST(shiftrightunsigned({fingerprint}, {k * width}) & {(1 << width) - 1} AS INT)"


def within_radius(found: DataFrame, items: DataFrame, limits: Limits) -> DataFrame:
    """Pairs of windows and items whose fingerprints differ in at most ``radius`` bits: all of them."""
    width = BITS // limits.blocks
    masks = F.lit(neighbours(width, limits.radius // limits.blocks))
    blocks = lambda side: ", ".join(f"struct({k} AS block, {block_sql(side, k, width)} AS value)" for k in range(limits.blocks))
    index = items.select("item_id", F.col("fingerprint").alias("item_print"), F.explode(F.expr(f"array({blocks('fingerprint')})")).alias("e"))
    index = index.withColumn("mask", F.explode(masks)).select("item_id", "item_print", F.col("e.block").alias("block"), F.expr("e.value ^ mask").alias("value"))
    probes = found.select("doc_id", "row", "start", "n_words", "fingerprint", F.explode(F.expr(f"array({blocks('fingerprint')})")).alias("e")).select("*", "e.block", "e.value").drop("e")
    # Spark takes the size of the item table for that of its many entries, and would broadcast them
    near = probes.join(index.hint("merge"), ["block", "value"]).where(F.expr(f"bit_count(fingerprint ^ item_print) <= {limits.radius}"))
    return near.select("doc_id", "row", "start", "n_words", "item_id").distinct()


def find_leaks(documents: DataFrame, benchmark: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``(doc_id, item_id, start, n_words, similarity)``: benchmark items found in documents.

    ``start`` (in words, from 0) and ``n_words`` give the most similar window (ties: the first).
    Similarity is that of five-word shingles weighted by their counts; an item of fewer words is one
    shingle of its whole sequence. Null texts are empty; items without words match nothing; rows
    with a null ``doc_id`` are searched and returned with it, and rows that repeat give one result
    for each ``doc_id`` and item. Other columns are ignored, and empty tables give no rows.
    """
    both = leaking_windows(documents, benchmark, limits)
    best = both.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", -F.col("start"), -F.col("n_words"))).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.col2")).alias("start"), (-F.col("b.col3")).alias("n_words"), F.col("b.similarity").alias("similarity"))


def row_of(documents: DataFrame) -> Column:
    """What names a row: a hash of its id and its text."""
    return F.xxhash64(documents["doc_id"], F.coalesce(documents["text"].cast("string"), F.lit("")))


def without_leaks(documents: DataFrame, benchmark: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of ``documents`` in which no benchmark item is found, with all their columns.

    Each row is judged by its own text, whether its ``doc_id`` is null or stands on several rows; columns
    may have any names.
    """
    found = stage(leaking_windows(documents, benchmark, limits).select(F.col("row").alias("_leak")).distinct(), "leaks")
    return documents.join(small(found, found.count(), limits.broadcast_rows), row_of(documents) == found["_leak"], "left_anti").select(*documents.columns)


def leaking_windows(documents: DataFrame, benchmark: DataFrame, limits: Limits) -> DataFrame:
    """``(doc_id, row, item_id, start, n_words, similarity)`` of all windows that are similar enough."""
    rows = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("row", row_of(rows))
    items = stage(item_table(benchmark), "items")
    found = stage(seeds(rows, items, limits), "seeds")
    shown = stage(windows(rows.join(found.select("row").distinct(), "row", "left_semi"), found).distinct(), "windows")
    near = within_radius(shown.drop("bag"), items, limits)
    both = near.join(shown.select(F.col("row").alias("r"), F.col("start").alias("s"), F.col("n_words").alias("n"), F.col("bag").alias("here")).distinct(), F.expr("row = r and start = s and n_words = n")).join(
        items.select("item_id", F.col("bag").alias("there")), "item_id"
    )
    both = both.select("doc_id", "row", "item_id", "start", "n_words", F.expr(weighted_jaccard_sql("here", "there")).alias("similarity"))
    return both.where(F.col("similarity") >= limits.similarity)
