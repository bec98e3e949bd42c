"""Centroid clustering of integer vectors, the nearest centroid found in a vantage-point tree.

Every round builds a vantage-point tree over the centroids on the driver and broadcasts it; tasks
search it for each of their vectors and send back sums per cluster, which Spark adds up. Vectors never
leave their partition.

The tree: an inner node holds one centroid, the vantage point, and two children with the least and
greatest distance of their centroids to it; a leaf holds a few centroids. The search is best first for
each vector on its own: of its open nodes it takes the one with the smallest lower bound (by the
triangle inequality), and stops when that bound is above the best distance found. A bound equal to the
best distance is still searched, and bounds are rounded down by more than their floating-point error,
so an equally near centroid of a smaller number is never lost. Distances at vantage points and in
leaves are exact 64-bit integers.

What grows with the data stays in Spark. The driver holds the centroids and their sums, ``clusters``
times ``size`` numbers by parameter, whatever the number of vectors.

Rows: vectors that are null, have another number of components, or a null, NaN or infinite one are left
out. Repeated rows are vectors of their own. Equal hashes of the start (repeated ids) are ordered by
components; vectors without an id are hashed as an empty id. With fewer vectors than ``clusters`` there
are as many centroids as vectors, without vectors there are no rows. A component of ``LIMIT`` or more
after scaling fails the job with a message: squared distances would not fit 64 bits. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm.common import map_arrow
from scorewright.scale import materialize

SIZE, SCALE, CLUSTERS, ROUNDS = 64, 1024, 8, 10
LIMIT = 1 << 27
LEAF = 2
#: Far above the error of a 64-bit square root or sum, far below any useful bound.
SLACK = 1e-9


class VantageTree:
    """A vantage-point tree over the rows of an integer matrix, in flat lists."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = np.asarray(points, np.int64)
        self.members: list[np.ndarray] = []  # of a leaf, or the vantage point alone
        self.children: list[list[tuple[int, float, float]]] = []  # node, least and greatest distance
        self._build(np.arange(len(self.points)), leaf)

    def _build(self, held: np.ndarray, leaf: int) -> int:
        node = len(self.members)
        self.members.append(held)
        self.children.append([])
        if len(held) <= leaf:
            return node
        # The point farthest from the first one has widely spread distances.
        vantage = held[squared(self.points[held], self.points[held[:1]])[:, 0].argmax()]
        rest = held[held != vantage]
        far = np.sqrt(squared(self.points[rest], self.points[[vantage]])[:, 0].astype(np.float64))
        order = np.argsort(far, kind="stable")
        self.members[node] = np.array([vantage])
        for part in np.array_split(order, 2):
            if len(part):
                child = self._build(np.sort(rest[part]), leaf)
                self.children[node].append((child, float(far[part].min()), float(far[part].max())))
        return node

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of and squared distance to the nearest point of each row; ties go to the smaller number."""
        n = len(vectors)
        best, who = np.full(n, np.iinfo(np.int64).max), np.full(n, len(self.points))
        reach = np.full(n, np.inf)
        lower = np.full((n, len(self.members)), np.inf)
        lower[:, 0] = 0.0
        active = np.arange(n)
        while len(active):
            chosen = lower[active].argmin(axis=1)
            bound = lower[active, chosen]
            alive = np.isfinite(bound) & (bound <= reach[active])
            active, chosen = active[alive], chosen[alive]
            for node in np.unique(chosen):
                rows = active[chosen == node]
                held = self.members[node]
                apart = squared(vectors[rows], self.points[held])
                least = apart.argmin(axis=1)  # the first of equals, and members are sorted
                found, number = apart[np.arange(len(rows)), least], held[least]
                better = (found < best[rows]) | ((found == best[rows]) & (number < who[rows]))
                best[rows[better]], who[rows[better]] = found[better], number[better]
                reach[rows] = np.sqrt(best[rows].astype(np.float64)) * (1 + SLACK)
                if self.children[node]:
                    root = np.sqrt(apart[:, 0].astype(np.float64))
                    for child, low, high in self.children[node]:
                        ring = np.maximum(root - high, low - root) - SLACK * (root + high)
                        lower[rows, child] = np.maximum(ring, lower[rows, node])
                lower[rows, node] = np.inf
        return who, best


def squared(vectors: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row of ``vectors`` to every row of ``points``."""
    found = np.empty((len(vectors), len(points)), np.int64)
    for k, point in enumerate(points):
        apart = vectors - point
        found[:, k] = np.einsum("ij,ij->i", apart, apart)
    return found


def integer_vectors(
    rows: DataFrame, *, key: str = "vec_id", vector: str = "embedding", size: int = SIZE, scale: int = SCALE
) -> DataFrame:
    """(key, v) of every usable row, ``v`` the components times ``scale``, rounded down."""
    doubles = F.col(vector).cast("array<double>")
    usable = F.forall("_x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.select(F.col(key), doubles.alias("_x")).where((F.size("_x") == size) & usable)
    too_large = F.raise_error(F.lit(f"component beyond {LIMIT} after scaling")).cast("int")
    whole = F.transform("_x", lambda x: F.when(F.abs(x * scale) >= LIMIT, too_large).otherwise(F.floor(x * scale).cast("int")))
    return kept.select(F.col(key).alias("id"), whole.alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return values.reshape(len(column), -1)


def _sums(vectors: DataFrame, tree) -> DataFrame:
    """Per cluster and component its sum, with the number of vectors: one row set per task, added up."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = tree.value
        sums = np.zeros(held.points.shape, np.int64)
        counts = np.zeros(len(sums), np.int64)
        for batch in batches:
            rows = _matrix(batch.column(0))
            who, _ = held.nearest(rows)
            np.add.at(sums, who, rows)
            np.add.at(counts, who, 1)
        used = np.flatnonzero(counts)
        size = sums.shape[1]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(used, size), pa.int32()),
                pa.array(np.tile(np.arange(size), len(used)), pa.int32()),
                pa.array(sums[used].ravel()),
                pa.array(np.repeat(counts[used], size)),
            ],
            ["cluster", "place", "total", "n"],
        )

    sent = map_arrow(vectors.select("v"), part, "cluster int, place int, total bigint, n bigint")
    return sent.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))


def _assigned(vectors: DataFrame, tree) -> DataFrame:
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who, best = tree.value.nearest(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(who, pa.int32()), pa.array(best)], ["id", "cluster", "distance"]
            )

    kind = vectors.schema["id"].dataType.simpleString()
    return map_arrow(vectors.select("id", "v"), part, f"id {kind}, cluster int, distance bigint")


def cluster(
    rows: DataFrame,
    *,
    key: str = "vec_id",
    vector: str = "embedding",
    size: int = SIZE,
    scale: int = SCALE,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    seed: int = 3,
) -> tuple[DataFrame, list[list[int]]]:
    """(key, cluster, distance) of every usable vector, and the final centroids.

    Starts from the ``clusters`` vectors whose sha256 of ``seed:key`` is smallest. A round that changes
    no centroid is the last: further ones would repeat it.
    """
    spark = rows.sparkSession
    vectors = materialize(integer_vectors(rows, key=key, vector=vector, size=size, scale=scale), "vectors")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    start = vectors.orderBy(name, "v").limit(clusters).select("v").collect()
    centroids = [list(row["v"]) for row in start]
    if not centroids:
        empty = vectors.select(F.col("id").alias(key), F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance"))
        return empty, []
    for _ in range(rounds):
        tree = spark.sparkContext.broadcast(VantageTree(centroids))
        moved = [list(centroid) for centroid in centroids]
        for row in _sums(vectors, tree).collect():  # clusters x size rows
            moved[row["cluster"]][row["place"]] = int(row["total"]) // row["n"]
        tree.unpersist()
        if moved == centroids:
            break
        centroids = moved
    tree = spark.sparkContext.broadcast(VantageTree(centroids))
    return materialize(_assigned(vectors, tree), "assigned").withColumnRenamed("id", key), centroids


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Adds the summed distance of the cluster and of all, and the digest of the centroid."""
    spark = assigned.sparkSession
    summed = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()
    whole = sum(int(row["d"]) for row in summed)
    facts = [(row["cluster"], int(row["d"]), whole, digest(centroids[row["cluster"]])) for row in summed]
    schema = "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    return assigned.join(F.broadcast(spark.createDataFrame(facts, schema)), "cluster")
