"""Hard-negative mining by blocked dense products of anchors and candidates.

Anchors are dealt over blocks of bounded size; one block at a time is broadcast, and every task
multiplies it with its own candidates, some thousands at a time: one matrix product in float64,
exact below 2**53. Candidates never move. A first pass keeps for each anchor its best candidates of
the same label, a second one for each of these positives the best candidates of other labels whose
score lies in the positive's window. Lists of the best merge: a task merges what its batches give
and returns a few rows for each anchor, and Spark merges the tasks' rows by anchor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from seekstone.llm.topk import EXACT, LEAST, MOST, floors, usable, whole
from seekstone.shared import stage

#: Scores that one product makes at most, so that a task's memory does not grow with the blocks.
CELLS = 1 << 21
FOUND = "anchor_id bigint, positive_id bigint, positive_score bigint, vec_id bigint, score bigint"
FOUND_TYPE = pa.schema([(name, pa.int64()) for name in ("anchor_id", "positive_id", "positive_score", "vec_id", "score")])


class Vectors:
    """Rows of whole numbers as a float64 matrix, and as Python's integers where rows are too large for that."""

    def __init__(self, column, scale: int, dims: int):
        self.raw, self.scale, self.dims = column, scale, dims
        self.x = floors(column, scale, dims)

    def peaks(self) -> np.ndarray:
        return np.abs(self.x).max(axis=1, initial=0)


def products(anchors: Vectors, rows: Vectors) -> np.ndarray:
    """All inner products as int64, those that no long holds as the nearest one.

    One matrix product where no sum can pass 2**53; pairs of a row or an anchor that could are worked
    out in Python's integers, the other pairs not.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        high, wide = anchors.peaks(), rows.peaks()
        limit = EXACT / max(1, rows.dims)
        plain, narrow = high * max(1.0, wide[wide < limit**0.5].max(initial=0)) < limit, wide < limit**0.5
        out = (np.where(plain[:, None], anchors.x, 0) @ np.where(narrow[:, None], rows.x, 0).T).astype(np.int64)
    for a, c in np.argwhere(~(plain[:, None] & narrow[None, :])):
        total = sum(p * q for p, q in zip(whole(anchors.raw[a], anchors.scale, rows.dims), whole(rows.raw[c], rows.scale, rows.dims)))
        out[a, c] = max(LEAST, min(MOST, total))
    return out


def rows_of(column: pa.Array) -> list[np.ndarray]:
    """The vectors of a list array, as views."""
    values, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(values, ends[:-1])


class Best:
    """For each of n lists the k best (score falling, id rising), merged from any number of batches."""

    def __init__(self, n: int, k: int):
        self.k, self.lists, self.ids, self.scores = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least = np.full(n, LEAST)

    def add(self, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` and ``allowed`` have a row for each list and a column for each of ``ids``, which rise."""
        keep = allowed & (scores >= self.least[:, None])
        if keep.sum() > 16 * self.k * len(self.least) and scores.shape[1] > self.k:
            at = scores.shape[1] - self.k
            cut = np.partition(np.where(keep, scores, LEAST), at, axis=1)[:, at, None]
            ties = keep & (scores == cut)  # of a common vector's rows only the first ids can stay
            keep = keep & (scores > cut) | ties & (np.cumsum(ties, axis=1, dtype=np.int32) <= self.k)
        lists, columns = np.nonzero(keep)
        if len(lists):
            self.merge(lists, ids[columns], scores[lists, columns])

    def merge(self, lists: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        lists, ids, scores = (np.concatenate(x) for x in ((self.lists, lists), (self.ids, ids), (self.scores, scores)))
        order = np.lexsort((ids, ~scores, lists))  # the complement turns the order of longs round without overflow
        lists, ids, scores = lists[order], ids[order], scores[order]
        rank = np.arange(len(lists)) - np.searchsorted(lists, lists)
        full = rank == self.k - 1
        self.least[lists[full]] = scores[full]
        self.lists, self.ids, self.scores = (x[rank < self.k] for x in (lists, ids, scores))


@dataclass
class Anchors:
    """One block of anchors, and in the second pass of their positives, as it is broadcast."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: list
    #: Of each list of the second pass: the anchor's place, the positive and its score, the least score.
    at: np.ndarray
    positives: np.ndarray
    scores: np.ndarray
    least: np.ndarray


def low_end(score: int, window: tuple[int, int]) -> int:
    """The least whole number n with ``window[0] * score <= window[1] * n``."""
    return max(LEAST, -(-window[0] * score // window[1]))


def search_block(candidates: DataFrame, block: Anchors, k: int, scale: int) -> DataFrame:
    """The best candidates of each list of a block: of the same label without positives, else of other
    labels within the positives' windows."""
    shared = candidates.sparkSession.sparkContext.broadcast(block)
    second = len(block.at) > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        n = len(b.at) if second else len(b.ids)
        best = Best(n, k)
        rows_at_once = max(64, CELLS // max(1, n))
        for batch in batches:
            for start in range(0, len(batch), rows_at_once):
                part = batch.slice(start, rows_at_once).sort_by("vec_id")
                ids, labels = (part[c].to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
                x = rows_of(part["x"])
                dims = max([1, *map(len, x), *map(len, b.vectors)])
                scores = products(Vectors(b.vectors, scale, dims), Vectors(x, scale, dims))
                alike = b.labels[:, None] == labels[None, :]
                if second:
                    scores, alike = scores[b.at], alike[b.at]
                    best.add(scores, ~alike & (scores >= b.least[:, None]) & (scores <= b.scores[:, None]), ids)
                else:
                    best.add(scores, alike & (b.ids[:, None] != ids[None, :]), ids)
        if second:
            columns = [b.ids[b.at[best.lists]], b.positives[best.lists], b.scores[best.lists], best.ids, best.scores]
        else:
            columns = [b.ids[best.lists], best.ids, best.scores, best.ids, best.scores]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=FOUND_TYPE)

    return candidates.select("vec_id", "label", "x").mapInArrow(run, FOUND)


def merged(found: DataFrame, k: int, *by: str) -> DataFrame:
    """The k best of each list over all tasks, with ``rank``."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, window: tuple[int, int] = (80, 100), scale: int = 256, block_rows: int = 2048) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``vectors`` and ``anchors`` have ``vec_id``, ``label`` and ``embedding``; components become
    ``floor(scale * x)``, a score is the inner product. An anchor's positives are its best rows of the
    same label; a positive's negatives are the best rows of other labels with
    ``window[0] * positive_score <= window[1] * score <= window[1] * positive_score``. Ties go to the
    smaller ``vec_id``. Rows with a null id, label, vector or component, or a non-finite one, take no
    part. Rows that repeat an id are candidates each, but never of an anchor with that id; of anchors
    that repeat an id the least (label, vector) asks. Missing components at the end of a shorter
    vector count as zero. A score that no long holds counts as the nearest long, in windows too. Empty
    tables give no rows; other columns are ignored, and so is a positive without negatives.

    A pass reads all candidates once for each block of anchors and moves none of them; the driver
    holds one block and its positives, ``block_rows`` x (1 + ``positives``) rows at most, besides a partition of sorted anchors.
    """
    spark = vectors.sparkSession
    rows = stage(labelled(vectors), "candidates")
    asking = labelled(anchors).groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("a")).select("vec_id", "a.label", "a.x")
    found = []
    for part in blocks_of(stage(asking, "anchors"), block_rows):
        first = merged(search_block(rows, part, positives, scale), positives, "anchor_id").drop("rank").distinct().collect()
        at = {int(key): k for k, key in enumerate(part.ids)}
        part.at = np.array([at[r["anchor_id"]] for r in first], np.int64)
        part.positives, part.scores = (np.array([r[c] for r in first], np.int64) for c in ("positive_id", "positive_score"))
        part.least = np.array([low_end(r["positive_score"], window) for r in first], np.int64)
        if first:
            best = merged(search_block(rows, part, negatives, scale), negatives, "anchor_id", "positive_id", "positive_score")
            found.append(stage(best, "negatives"))
    if not found:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def labelled(vectors: DataFrame) -> DataFrame:
    """``(vec_id, label, x)`` of the rows that take part."""
    return usable(vectors, "label").where("label is not null").select("vec_id", F.col("label").cast("bigint").alias("label"), "x")


def blocks_of(anchors: DataFrame, block_rows: int) -> Iterator[Anchors]:
    """All anchors in order of their ids, ``block_rows`` at a time; the driver reads one partition after another."""
    none = np.zeros(0, np.int64)
    rows: list = []

    def made() -> Anchors:
        return Anchors(np.array([r["vec_id"] for r in rows], np.int64), np.array([r["label"] for r in rows], np.int64), [list(r["x"]) for r in rows], none, none, none, none)

    for r in anchors.orderBy("vec_id").toLocalIterator():
        rows.append(r)
        if len(rows) == block_rows:
            yield made()
            rows = []
    if rows:
        yield made()
