"""Lloyd's rounds on integers, with an annulus search for the nearest centroid.

Centroids are sorted by norm. The distance of a vector to a centroid is at least the difference of their norms, so with an
upper bound of the distance, from the two centroids next to the vector's norm, only those in an annulus around it can be
nearest: a binary search finds them, and they are compared exactly, those on the border too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.llm.common import remove, scratch

#: Components up to it are computed in 64-bit integers; larger ones in Python's, and no further than FURTHEST.
NARROW, FURTHEST, LONGEST = 1 << 27, 1 << 40, (1 << 63) - 1


def kept(vectors: DataFrame, size: int = 64) -> DataFrame:
    """vec_id and embedding of the rows with exactly so many components, none null, NaN or infinite."""
    whole = (F.size("embedding") == size) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("embedding").isNotNull() & whole).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def integers(batch: pa.RecordBatch, scale: int) -> np.ndarray:
    column = batch["embedding"]
    scaled = np.floor(column.flatten().to_numpy(zero_copy_only=False) * scale).reshape(len(column), -1)
    scaled = np.clip(scaled, -FURTHEST, FURTHEST).astype(np.int64)
    return scaled if np.abs(scaled).max(initial=0) < NARROW else scaled.astype(object)


class Annulus:
    """The nearest of some centroids."""

    def __init__(self, centroids: list[list[int]]) -> None:
        wide = max((abs(x) for c in centroids for x in c), default=0) >= NARROW
        plain = np.array(centroids, object if wide else np.int64)
        norms = np.sqrt((plain.astype(float) ** 2).sum(axis=1))
        self.number = np.argsort(norms, kind="stable")
        self.centroids, self.norms = plain[self.number], norms[self.number]

    def distance(self, vectors: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Squared distances of vectors to the centroids at these places of the sorted list, exactly."""
        apart = vectors - self.centroids[places]
        return (apart * apart).sum(axis=1)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each vector's nearest centroid (ties: the smaller one) and the squared distance."""
        k = len(self.norms)
        norms = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
        near = np.clip(np.searchsorted(self.norms, norms), 0, k - 1)
        best, number = self.distance(vectors, near), self.number[near]
        below = np.maximum(near - 1, 0)
        best, number = self._better(best, number, self.distance(vectors, below), self.number[below])
        # rounding can't push a centroid of the border out of the annulus
        radius = np.sqrt(best.astype(float)) * (1 + 1e-9) + norms * 1e-9 + 1e-6
        first, end = np.searchsorted(self.norms, norms - radius, "left"), np.searchsorted(self.norms, norms + radius, "right")
        for step in range(int((end - first).max(initial=0))):
            rows = np.flatnonzero(first + step < end)
            places = first[rows] + step
            best[rows], number[rows] = self._better(best[rows], number[rows], self.distance(vectors[rows], places), self.number[places])
        return number, best

    @staticmethod
    def _better(best: np.ndarray, number: np.ndarray, other: np.ndarray, its_number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wins = (other < best) | (other == best) & (its_number < number)
        return np.where(wins, other, best), np.where(wins, its_number, number)


def seeds(rows: DataFrame, k: int, scale: int) -> list[list[int]]:
    """The vectors whose ids have the smallest hashes; nulls come last, repeated ids by their components."""
    order = [F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), F.col("embedding").asc()]
    found = rows.orderBy(*order).limit(k).toArrow()
    return [[int(x) for x in row] for batch in found.to_batches() if len(batch) for row in integers(batch, scale)]


def _sums(rows: DataFrame, centroids: list[list[int]], scale: int) -> dict[int, tuple[int, list[int]]]:
    """The number of vectors of each centroid and the sums of their components. A task sends one row a centroid."""
    size = len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, counts, sums = Annulus(centroids), np.zeros(len(centroids), np.int64), np.zeros((len(centroids), size), object)
        for batch in batches:
            vectors = integers(batch, scale)
            number, _ = search.nearest(vectors)
            for c in np.unique(number):
                mine = vectors[number == c]
                counts[c] += len(mine)
                sums[c] += mine.sum(axis=0).astype(object)
        used = np.flatnonzero(counts)
        texts = pa.array([[str(x) for x in sums[c]] for c in used], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used]), texts], ["cluster", "n", "sums"])

    sent = rows.mapInArrow(run, "cluster int, n long, sums array<string>").select("cluster", "n", F.posexplode("sums").alias("at", "part"))
    total = sent.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("sum"))
    out: dict[int, tuple[int, list[int]]] = {}
    for row in total.orderBy("at").collect():  # k rows a component
        out.setdefault(row["cluster"], (row["n"], []))[1].append(int(row["sum"]))
    return out


def _assigned(rows: DataFrame, centroids: list[list[int]], scale: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Annulus(centroids)
        for batch in batches:
            number, far = search.nearest(integers(batch, scale))
            far = pa.array([min(x, LONGEST) for x in far] if far.dtype == object else far, pa.int64())
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(number, pa.int32()), far], ["vec_id", "cluster", "distance"])

    return rows.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64) -> tuple[DataFrame, list[list[int]]]:
    """vec_id, cluster and distance (squared) of every kept vector, and the final centroids.

    Components become floor(scale * x). Rounds assign all vectors and replace each centroid that has some by the floor of
    their mean. Nothing of a vector is shuffled: a round is one scan, of which k sums are gathered. Rows with a null or
    repeated vec_id count each for themselves; a null id is a seed only where there are too few others. Components beyond
    2^40 count as 2^40, and distances beyond a long as the greatest long. No vectors: no rows and no centroids.
    """
    rows = kept(vectors, size)
    centroids = seeds(rows, k, scale)
    if not centroids:
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    for _ in range(rounds):
        sums = _sums(rows, centroids, scale)
        centroids = [[x // sums[c][0] for x in sums[c][1]] if c in sums else old for c, old in enumerate(centroids)]
    return _assigned(rows, centroids, scale), centroids


def _long(total: Column) -> Column:
    return F.least(total, F.lit(LONGEST).cast("decimal(38,0)")).cast("long")


def inertias(assigned: DataFrame) -> DataFrame:
    """cluster, cluster_inertia, inertia: sums of the distances in each cluster and in all; one row for each cluster."""
    distance = F.col("distance").cast("decimal(38,0)")
    summed = assigned.groupBy("cluster").agg(F.sum(distance).alias("sum"))
    whole = F.sum("sum").over(Window.partitionBy(F.lit(1)))
    return summed.select("cluster", _long(F.col("sum")).alias("cluster_inertia"), _long(whole.cast("decimal(38,0)")).alias("inertia"))


def clustered(vectors: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid (components of the final centroid, joined by commas)
    of every kept vector. What clusters have in common is k rows. Cases as in cluster."""
    spark = vectors.sparkSession
    assigned, centroids = cluster(vectors, k, rounds, size, scale)
    path = scratch(spark, "clusters")
    assigned.write.parquet(path)  # ids and distances only
    found = {row["cluster"]: row for row in inertias(spark.read.parquet(path)).collect()}  # k rows
    remove(spark, path)
    common = [(c, found[c]["cluster_inertia"], found[c]["inertia"], ",".join(map(str, x))) for c, x in enumerate(centroids) if c in found]
    table = spark.createDataFrame(common, "cluster int, cluster_inertia long, inertia long, centroid string")
    return assigned.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
