"""Exact top-k inner products by no-random-access aggregation (NRA) over sorted lists.

Vectors become integers, ``floor(scale * x)``. Candidates are dealt over blocks of bounded size and
queries over blocks of their own; a task holds one block of each. Per block and dimension there is
one list of candidates sorted by component. A query reads all lists in step, each from its better
end, where a row contributes ``q[d] * x[d]``; it keeps a lower and an upper bound of every
candidate's score: what it has seen, plus for each list it was not seen in the list's worst or the
last contribution read. Reading stops when no candidate outside a few can still qualify, ties
included. Scores of those few are then resolved exactly. The k best of every block meet in one last
ranking.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

#: Integer sums up to this are exact in double precision.
EXACT = 2**53
#: A score beyond what a long holds counts as the nearest long.
LEAST, MOST = -(2**63), 2**63 - 1


class SortedLists:
    """A block of vectors with one list of rows per dimension, sorted by component."""

    def __init__(self, x: np.ndarray):
        self.x = x.astype(float)
        self.order = np.argsort(self.x.T, axis=1, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(self.x.T, self.order, axis=1)

    def entries(self, lists: np.ndarray, upper: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and components of the entries ``start`` to ``end`` of some lists, each counted from its
        upper or its lower end."""
        n = self.x.shape[0]
        rows, values = np.empty((len(lists), end - start), np.int32), np.empty((len(lists), end - start))
        high, low = lists[upper], lists[~upper]
        rows[upper], values[upper] = self.order[high, n - end : n - start][:, ::-1], self.values[high, n - end : n - start][:, ::-1]
        rows[~upper], values[~upper] = self.order[low, start:end], self.values[low, start:end]
        return rows, values


def nra(lists: SortedLists, keys: np.ndarray, query: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows and scores of the k best of a query by (score falling, key rising), and the entries read.

    ``keys`` are the rows' ids; a row whose key is ``own`` takes no part. Depths double from a
    sixteenth of the lists. A row is out when its upper bound is below the k-th best lower bound.
    """
    n = lists.x.shape[0]
    at = np.flatnonzero(query)  # a list that a query has no weight for tells nothing
    weight, other = query[at].astype(float), keys != own
    upper = weight > 0
    ends = weight * np.where(upper, lists.values[at, 0], lists.values[at, -1])  # each list's worst
    least = np.full(n, ends.sum())
    rows = np.flatnonzero(other)
    depth, to, few = 0, max(1, n // 16), max(4 * k, 16)
    read: list[np.ndarray] = []
    while len(rows) > few and depth < n and len(at):
        seen, values = lists.entries(at, upper, depth, to)
        read.append(seen)
        gained = weight[:, None] * values
        least += np.bincount(seen.ravel(), weights=(gained - ends[:, None]).ravel(), minlength=n)
        open_ = gained[:, -1] - ends  # what a list not seen in may still add to its worst
        known = sum(np.bincount(r.ravel(), weights=np.repeat(open_, r.shape[1]), minlength=n) for r in read)
        most = least + open_.sum() - known
        if len(rows) > k:
            rows = rows[most[rows] >= np.partition(least[rows], len(rows) - k)[len(rows) - k]]
        depth, to = to, min(n, 2 * to)
    score = lists.x[rows] @ query.astype(float)
    order = np.lexsort((keys[rows], -score))[:k]
    return rows[order], score[order].astype(np.int64), depth * len(at)


def exact_int64(x: np.ndarray, q: np.ndarray) -> bool:
    """Whether every product sum of rows of x and q fits a double exactly."""
    if not x.size or not q.size:
        return True
    return float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1] < EXACT


def floors(vectors: pd.Series, scale: int, dims: int) -> np.ndarray:
    """``floor(scale * x)`` of every component, zeros behind shorter vectors; exact where it is finite."""
    out = np.zeros((len(vectors), dims))
    for row, v in zip(out, vectors):
        with np.errstate(over="ignore"):
            row[: len(v)] = np.floor(float(scale) * np.asarray(v, float))
    return out


def whole(vector: np.ndarray, scale: int, dims: int) -> list[int]:
    """The same as Python integers, for any finite component."""
    scaled = [int(np.floor(scale * v)) if abs(v) < 2.0**900 else scale * int(v) for v in map(float, vector)]
    return scaled + [0] * (dims - len(scaled))


def whole_numbers(x: list[list[int]], keys: np.ndarray, query: list[int], k: int, own: int) -> tuple[list[int], list[int]]:
    """The k best in Python's integers, for components too large for doubles."""
    scored = ((-max(LEAST, min(MOST, sum(a * b for a, b in zip(v, query)))), int(key), row) for row, (v, key) in enumerate(zip(x, keys)) if key != own)
    best = sorted(scored)[:k]
    return [r for _, _, r in best], [-s for s, _, _ in best]


def usable(vectors: DataFrame, *more: str) -> DataFrame:
    """``(vec_id, x)`` with components as doubles of the rows that take part, and columns named besides."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.where("vec_id is not null and embedding is not null").select("vec_id", x.alias("x"), *more).where(~bad)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, block_rows: int = 8192, query_block_rows: int = 2048) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best candidates of each query, without itself.

    ``vectors`` and ``queries`` have ``vec_id`` and ``embedding``. Ties go to the smaller ``vec_id``;
    candidates with the query's own id take no part in its list. Null vectors, null or non-finite
    components leave their row out on either side; missing components at the end of a shorter vector
    count as zero. Rows with the same ``vec_id`` are one candidate each; of queries with the same
    ``vec_id`` the least vector asks. Scores are exact integers whatever the components' size; one
    that no long holds counts as the nearest long, also in the ranking. Empty tables give no rows;
    other columns are ignored.

    A candidate moves once for each block of queries, a query once for each block of candidates.
    """
    candidates, asked = usable(vectors), usable(queries).groupBy("vec_id").agg(F.min("x").alias("x"))
    n_blocks = max(1, -(-candidates.count() // block_rows))
    n_query_blocks = max(1, -(-asked.count() // query_block_rows))
    spread = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    left = candidates.select("vec_id", "x", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_blocks)).cast("int").alias("block"), F.explode(spread(n_query_blocks)).alias("query_block"))
    right = asked.select("vec_id", "x", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(n_query_blocks)).cast("int").alias("query_block"), F.explode(spread(n_blocks)).alias("block"))

    def search(block: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(block) and len(asking):
            block = block.sort_values("vec_id", kind="stable")
            keys = block["vec_id"].to_numpy(np.int64)
            dims = max(max(map(len, block["x"])), max(map(len, asking["x"])))
            x, q = floors(block["x"], scale, dims), floors(asking["x"], scale, dims)
            asked_keys = asking["vec_id"].to_numpy(np.int64)
            if exact_int64(x, q):
                lists = SortedLists(x)
                found = [nra(lists, keys, query, k, key)[:2] for query, key in zip(q, asked_keys)]
            else:
                numbers = [whole(v, scale, dims) for v in block["x"]]
                found = [whole_numbers(numbers, keys, whole(v, scale, dims), k, key) for v, key in zip(asking["x"], asked_keys)]
            for key, (rows, scores) in zip(asked_keys, found):
                out["query_id"] += [key] * len(rows)
                out["vec_id"] += list(keys[rows])
                out["score"] += list(scores)
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "int64"})

    best = left.groupBy("block", "query_block").cogroup(right.groupBy("block", "query_block")).applyInPandas(search, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
