"""Centroid clustering by sort-means: exact Lloyd rounds that look at few centroids per vector.

A round has the centroids' distances from each other and, for each centroid, the others in the order
of their distance from it. A vector starts at the centroid it was assigned to before and walks that
centroid's order; at the first centroid that lies strictly beyond twice the vector's distance from
where it started, no later one can be nearer or tie, and the walk stops. Everything is integers:
components are ``floor(scale * x)``, distances are squared, means are floors of exact quotients.

A round is one pass over the table of the round before: vectors stay in their partitions, each task
adds up its own vectors by cluster and leaves the sums in one last row of what it writes, and only
those sums are shuffled. A cluster of any size is thus never gathered. The written table cuts
lineage; the one before it is deleted once no plan reads it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from seekstone.shared import discard, stage

#: Components below this make four times a squared distance of up to 1,024 dimensions fit a long.
SMALL = 2**24
#: A distance or sum beyond what a long holds counts as the largest long.
MOST = 2**63 - 1
#: Sums travel in pieces of so many bits, so that sums of pieces over all tasks fit a long.
LIMB_BITS = 40
START = 0
STATE = "vec_id bigint, x array<double>, cluster int, sums array<struct<cluster:int,dim:int,limb:int,value:bigint>>"
SUM_TYPE = pa.list_(pa.struct([("cluster", pa.int32()), ("dim", pa.int32()), ("limb", pa.int32()), ("value", pa.int64())]))
STATE_TYPE = pa.schema([("vec_id", pa.int64()), ("x", pa.list_(pa.float64())), ("cluster", pa.int32()), ("sums", SUM_TYPE)])


def kept_vectors(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """``(vec_id, x)`` with ``x = floor(scale * component)``, whole numbers as doubles, of the rows that take part."""
    x = F.transform("embedding", lambda v: _floor(F.lit(float(scale)) * v.cast("double")))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vectors.where(F.size("embedding") == dims).select(F.col("vec_id").cast("bigint").alias("vec_id"), x.alias("x")).where(finite)


def _floor(x):
    """Floor as a double, of values beyond longs too: those are whole numbers already."""
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


def squared(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows from one centroid; object arrays hold integers of any size."""
    step = x - centre
    return (step * step).sum(axis=1)


class Centroids:
    """The centroids of a round with their mutual distances and each one's order of the others."""

    def __init__(self, centres: list[list[int]]):
        self.large = any(abs(v) >= SMALL for c in centres for v in c)
        exact = np.array(centres, dtype=object)
        apart = np.array([squared(exact, c) for c in exact], dtype=object).reshape(len(centres), len(centres))
        self.orders = [sorted((j for j in range(len(centres)) if j != a), key=lambda j: (apart[a, j], j)) for a in range(len(centres))]
        self.known = {np.dtype(object): (exact, apart)}
        if not self.large:
            self.known[np.dtype(np.int64)] = exact.astype(np.int64), apart.astype(np.int64)

    def nearest(self, x: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Each row's nearest centroid (ties: the smaller number), its squared distance, and how many
        distances were worked out. ``x`` is int64 with small components, or object."""
        centres, apart = self.known[x.dtype]
        found, distance = before.copy(), np.zeros(len(x), x.dtype)
        looked = 0
        for a in np.unique(before):
            rows = np.flatnonzero(before == a)
            here = squared(x[rows], centres[a])
            rows, here = rows[(far := np.argsort(-here, kind="stable"))], here[far]
            best, number = here.copy(), np.full(len(rows), a, before.dtype)
            looked += len(rows)
            for j in self.orders[a]:
                # rows come with the farthest first, so those that go on are always the first ones
                active = int(np.searchsorted(-4 * here, -apart[a, j], side="right"))
                if not active:
                    break
                looked += active
                other = squared(x[rows[:active]], centres[j])
                better = (other < best[:active]) | (other == best[:active]) & (j < number[:active])
                best[:active][better], number[:active][better] = other[better], j
            found[rows], distance[rows] = number, best
        return found, distance, looked

    def assign(self, values: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Clusters and distances (the largest long at most) of rows of whole doubles; only rows with
        large components, or all where a centroid is large, are worked out in Python's integers."""
        wide = np.full(len(values), self.large) | (np.abs(values) >= SMALL).any(axis=1)
        found, distance = before.copy(), np.zeros(len(values), np.int64)
        for rows, kind in ((np.flatnonzero(~wide), np.int64), (np.flatnonzero(wide), object)):
            if len(rows):
                x = values[rows].astype(np.int64) if kind is np.int64 else whole(values[rows])
                found[rows], d, _ = self.nearest(x, before[rows])
                distance[rows] = np.minimum(d, MOST).astype(np.int64)
        return found, distance


def whole(values: np.ndarray) -> np.ndarray:
    out = np.empty(values.shape, dtype=object)
    out.ravel()[:] = [int(v) for v in values.ravel()]
    return out


def cluster_sums(values: np.ndarray, found: np.ndarray, to: dict[int, list]) -> None:
    """Add rows to ``to``: by cluster the number of rows and the exact sums of their components."""
    for c in np.unique(found):
        rows = values[found == c]
        small = (np.abs(rows) < SMALL).all(axis=1)
        sums = rows[small].astype(np.int64).sum(axis=0).tolist()
        if not small.all():
            sums = [a + b for a, b in zip(sums, whole(rows[~small]).sum(axis=0))]
        had = to.setdefault(int(c), [0, [0] * values.shape[1]])
        had[0] += len(rows)
        had[1] = [a + b for a, b in zip(had[1], sums)]


def limbs(sums: dict[int, list]) -> list[dict]:
    """Counts (dimension -1) and sums as pieces of LIMB_BITS bits that carry the sum's sign."""
    out = []
    for c, (n, parts) in sums.items():
        for dim, value in [(-1, n), *enumerate(parts)]:
            sign, rest, limb = (1 if value >= 0 else -1), abs(value), 0
            while rest:
                rest, piece = divmod(rest, 1 << LIMB_BITS)
                out.append({"cluster": c, "dim": dim, "limb": limb, "value": sign * piece})
                limb += 1
    return out


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def assigned(state: DataFrame, centres: list[list[int]], dims: int, sums: bool) -> DataFrame:
    """``state`` with the clusters under ``centres``. With ``sums`` each task's last row has its sums;
    without, ``x`` goes and ``distance`` comes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, totals = Centroids(centres), {}
        for batch in batches:
            if not len(batch):
                continue
            values = matrix(batch["x"], dims)
            found, distance = known.assign(values, batch["cluster"].to_numpy(zero_copy_only=False))
            if sums:
                cluster_sums(values, found, totals)
                columns = [batch["vec_id"], batch["x"], pa.array(found, pa.int32()), pa.nulls(len(batch), SUM_TYPE)]
                yield pa.RecordBatch.from_arrays(columns, schema=STATE_TYPE)
            else:
                yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(found, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])
        if totals:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.float64())), pa.nulls(1, pa.int32()), pa.array([limbs(totals)], SUM_TYPE)], schema=STATE_TYPE)

    return state.select("vec_id", "x", "cluster").mapInArrow(run, STATE if sums else "vec_id bigint, cluster int, distance bigint")


def next_centres(written: DataFrame, centres: list[list[int]]) -> list[list[int]]:
    """Floors of the means, from the sums that tasks left: at most clusters x (dimensions + 1) x limbs
    rows come to the driver. An empty cluster's centroid stays."""
    parts = written.where("sums is not null").select(F.explode("sums").alias("s")).groupBy("s.cluster", "s.dim", "s.limb").agg(F.sum("s.value").alias("value"))
    counts, sums = {}, {}
    for r in parts.collect():
        to = counts if r["dim"] < 0 else sums
        key = r["cluster"] if r["dim"] < 0 else (r["cluster"], r["dim"])
        to[key] = to.get(key, 0) + (r["value"] << (LIMB_BITS * r["limb"]))
    return [[sums.get((c, d), 0) // counts[c] for d in range(len(centre))] if counts.get(c) else centre for c, centre in enumerate(centres)]


def first_centres(kept: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest ``sha256("<seed>:<vec_id>")``; rows of one id by their components, null ids last."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [[int(v) for v in r["x"]] for r in kept.select(digest.alias("digest"), "x").orderBy(F.asc_nulls_last("digest"), "x").limit(k).collect()]


def sort_means(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> tuple[DataFrame, list[list[int]]]:
    """``(vec_id, cluster, distance)`` of each vector kept, and the final centroids.

    ``vectors`` has ``vec_id`` and ``embedding``; other columns are ignored. Kept are rows of exactly
    ``dims`` components, none null or non-finite (nor after scaling in double precision). Repeated rows
    and rows that repeat an id or have none are vectors of their own; with fewer than k vectors each
    starts a centroid; equal centroids tie to the smaller number; an empty table gives no rows and no
    centroids. Distances are squared integers, those beyond a long count as the largest long; which
    centroid is nearest never suffers from that.
    """
    spark = vectors.sparkSession
    kept = stage(kept_vectors(vectors, dims, scale), "vectors")
    centres = first_centres(kept, k, seed)
    if not centres:
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint"), []
    state, owned = kept.withColumn("cluster", F.lit(START)), kept
    for _ in range(rounds):
        written = stage(assigned(state, centres, dims, sums=True), "clusters")
        centres = next_centres(written, centres)
        discard(owned)
        state, owned = written.where("sums is null"), written
    out = stage(assigned(state, centres, dims, sums=False), "assigned")
    discard(owned)
    return out, centres


def digests(spark: SparkSession, found: DataFrame, centres: list[list[int]]) -> DataFrame:
    """Each vector with its cluster's and the whole sum of distances and its centroid's digest.

    Sums beyond a long count as the largest long. What joins the vectors is one row a cluster.
    """
    most = F.lit(MOST).cast("decimal(38,0)")
    by_cluster = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.least(F.sum(F.col("distance").cast("decimal(38,0)")), most).alias("s")).collect()}
    every = min(MOST, sum(by_cluster.values()))
    rows = [(c, min(MOST, by_cluster.get(c, 0)), every, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centres)]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
