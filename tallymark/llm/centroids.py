"""Centroid clustering of whole-number vectors by scalar lookup tables.

A vector's components become whole numbers once, and vectors are stored in
blocks: per dimension the values that occur in the block, and per vector the
place of its value among them. A round tabulates, for each dimension, occurring
value and centroid, the squared difference; a vector's distances are then sums
of table rows, and nothing is multiplied per vector. Tables are as large as a
block has values, however many vectors there are; only sums per cluster and
dimension leave the tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.settle import settle

DIMENSIONS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
BLOCK = 8192  # vectors of a block; places fit 16 bits
#: Whole numbers up to this size have squared distances that fit 64 bits.
LARGEST = 1 << 27

_BLOCKS = "ids array<long>, `values` array<long>, starts array<int>, places binary"


def whole_vectors(
    df: DataFrame, vec_id: str, embedding: str, dimensions: int = DIMENSIONS, scale: int = SCALE
) -> DataFrame:
    """(id, v) of the rows whose vector has ``dimensions`` finite components; v holds floor(scale * x).

    Rows without a vector, with another length or a missing, infinite or NaN
    component are left out; rows that repeat stay, and so do those without id. A
    component whose whole number is beyond ``LARGEST`` fails the job.
    """
    x = F.col(embedding).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf"))))
    large = F.raise_error(F.lit(f"a component times {scale} is beyond {LARGEST}")).cast("bigint")

    def whole(c):
        scaled = F.floor(c * F.lit(float(scale)))
        return F.when(F.abs(c * F.lit(float(scale))) < F.lit(float(LARGEST)), scaled).otherwise(large)

    return df.where((F.size(x) == dimensions) & finite).select(
        F.col(vec_id).cast("long").alias("id"), F.transform(x, whole).alias("v")
    )


def first_centroids(vectors: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors with the smallest SHA-256 of "seed:id"; those without id come last, equal ids by vector."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    rows = vectors.orderBy(digest.asc_nulls_last(), F.col("v")).limit(clusters).collect()
    return np.array([r["v"] for r in rows], np.int64)


def blocks(vectors: DataFrame) -> DataFrame:
    """Vectors in blocks: ids, the occurring values by dimension, and each vector's places among them."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                v = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                occurring, places = zip(*(np.unique(column, return_inverse=True) for column in v.T))
                starts = np.cumsum([0, *map(len, occurring)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())),
                        pa.array([np.concatenate(occurring)], pa.list_(pa.int64())),
                        pa.array([starts], pa.list_(pa.int32())),
                        pa.array([np.stack(places).astype(np.uint16).tobytes()], pa.binary()),
                    ],
                    names=["ids", "values", "starts", "places"],
                )

    return vectors.mapInArrow(run, _BLOCKS)


def _unpacked(batches):
    """(ids, occurring values per dimension, places by dimension and vector) of each block."""
    for batch in batches:
        for i in range(batch.num_rows):
            values, starts = (batch.column(c)[i].values.to_numpy() for c in (1, 2))
            places = np.frombuffer(batch.column(3)[i].as_buffer(), np.uint16).reshape(len(starts) - 1, -1)
            yield batch.column(0)[i].values, [values[a:b] for a, b in zip(starts[:-1], starts[1:])], places


def nearest(occurring: list[np.ndarray], places: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each vector of a block; among equals the smaller number."""
    total = np.zeros((places.shape[1], len(centroids)), np.int64)
    for d, values in enumerate(occurring):
        table = (values[:, None] - centroids[None, :, d]) ** 2
        total += table.take(places[d], axis=0)
    cluster = total.argmin(axis=1)
    return cluster, total[np.arange(len(cluster)), cluster]


def cluster_sums(stored: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Per cluster that has vectors: their number and the sum of each component."""
    clusters, dimensions = centroids.shape

    def run(batches):
        sums, counts = np.zeros((dimensions, clusters), np.int64), np.zeros(clusters, np.int64)
        for _, occurring, places in _unpacked(batches):
            cluster, _ = nearest(occurring, places, centroids)
            counts += np.bincount(cluster, minlength=clusters)
            for d, values in enumerate(occurring):
                # a block's sums stay below 2**53, so doubles hold them exactly
                sums[d] += np.bincount(cluster, values[places[d]], clusters).astype(np.int64)
        d, c = np.divmod(np.arange(sums.size), clusters)
        there = counts[c] > 0
        columns = [c[there], d[there], sums.ravel()[there], counts[c][there]]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["c", "d", "total", "n"])

    parts = stored.mapInArrow(run, "c long, d long, total long, n long")
    found: dict[int, tuple[int, list[int]]] = {}
    rows = parts.groupBy("c", "d").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    for r in sorted(rows):  # clusters times dimensions rows
        found.setdefault(r["c"], (r["n"], []))[1].append(r["total"])
    return found


def cluster(
    df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dimensions: int = DIMENSIONS,
    clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED,
) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of each vector that ``whole_vectors`` keeps, and the last centroids.

    Each round assigns all vectors, then moves every centroid that has vectors to the
    floor of their mean; one without stays. There are fewer centroids where there
    are fewer vectors, and none for an empty table. Building the result runs
    jobs: the blocks are written and read once a round.
    """
    vectors = whole_vectors(df, vec_id, embedding, dimensions, scale)
    centroids = first_centroids(vectors, clusters, seed)
    if not len(centroids):
        return vectors.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    stored = settle(blocks(vectors))
    for _ in range(rounds):
        centroids = centroids.copy()
        for c, (n, sums) in cluster_sums(stored, centroids).items():
            centroids[c] = [total // n for total in sums]

    def run(batches):
        for ids, occurring, places in _unpacked(batches):
            number, distance = nearest(occurring, places, centroids)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(number, pa.int32()), pa.array(distance, pa.int64())], names=["id", "cluster", "distance"]
            )

    return stored.mapInArrow(run, "id long, cluster int, distance long"), centroids


def report(assigned: DataFrame, centroids: np.ndarray, vec_id: str = "vec_id") -> DataFrame:
    """Each vector's cluster and distance, with the inertia of its cluster and of all, and its centroid's digest."""
    assigned = settle(assigned)
    inertia = {r["cluster"]: r["total"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def of_cluster(values, kind):
        # a value for each of a few clusters
        return F.get(F.array(*[F.lit(v).cast(kind) for v in values]).cast(f"array<{kind}>"), F.col("cluster"))

    return assigned.select(
        F.col("id").alias(vec_id), "cluster", "distance",
        of_cluster([inertia.get(c, 0) for c in range(len(centroids))], "long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        of_cluster(digests, "string").alias("centroid_sha256"),
    )
