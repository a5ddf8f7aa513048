"""Centroid clustering (Lloyd's rounds in whole numbers) with nearest centroids by the threshold algorithm.

For each dimension the centroids are sorted by their value.  A vector walks every list outward from its own value, the
nearer side first; a centroid that turns up for the first time is measured exactly.  Whatever has not turned up is at
least as far in each dimension as the walk has come, so the walk stops once the sum over these frontiers is strictly
above the best exact distance (a tie could still go to a smaller number).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import kept, prepare, releasing

#: Vectors that walk together in a task.
WALK_ROWS = 1024
#: Components of larger magnitude are refused: sums of squares would leave the range of 64 bits.
MOST = 1 << 26
_FAR = np.iinfo(np.int64).max // 4


class SortedLists:
    """The centroids' values and numbers, sorted for each dimension."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.number = np.argsort(centroids, axis=0, kind="stable")
        self.value = np.take_along_axis(centroids, self.number, 0)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(centroid, squared distance) of each row of ``x``, and how many distances were measured."""
        k, dims = self.centroids.shape
        high = np.stack([np.searchsorted(self.value[:, d], x[:, d]) for d in range(dims)], axis=1)
        low, dim = high - 1, np.arange(dims)
        known = np.full((len(x), k), _FAR)
        rows, measured = np.arange(len(x)), 0
        for _ in range(k):
            here = x[rows]
            below = np.where(low >= 0, here - self.value[np.maximum(low, 0), dim], _FAR)
            above = np.where(high < k, self.value[np.minimum(high, k - 1), dim] - here, _FAR)
            down = below <= above
            frontier = np.where(down, below, above)
            met = self.number[np.where(down, low, high), dim]
            low, high = low - down, high + ~down
            new = np.zeros((len(rows), k), bool)
            new[np.arange(len(rows))[:, None], met] = True
            r, c = np.nonzero(new & (known[rows] == _FAR))
            measured += len(r)
            known[rows[r], c] = ((here[r] - self.centroids[c]) ** 2).sum(axis=1)
            best = known[rows].min(axis=1)
            on = ((frontier**2).sum(axis=1) <= best) & (known[rows] == _FAR).any(axis=1)
            rows, low, high = rows[on], low[on], high[on]
            if not len(rows):
                break
        return known.argmin(axis=1), known.min(axis=1), measured


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(len(column), -1)


def _walks(lists: SortedLists, batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for k in range(0, batch.num_rows, WALK_ROWS):
            part = batch.slice(k, WALK_ROWS)
            x = _matrix(part.column("x"))
            yield part, x, *lists.nearest(x)[:2]


def _summed(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = centroids.shape
        total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for _, x, cluster, _ in _walks(SortedLists(centroids), batches):
            order = np.argsort(cluster, kind="stable")
            names, first = np.unique(cluster[order], return_index=True)
            total[names] += np.add.reduceat(x[order], first, axis=0)
            count += np.bincount(cluster, minlength=k)
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(held, dims).astype(np.int32)), pa.array(np.tile(np.arange(dims), len(held)).astype(np.int32)),
            pa.array(total[held].ravel()), pa.array(np.repeat(count[held], dims))], names=["cluster", "dim", "total", "n"])
    return run


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, cluster, distance in _walks(SortedLists(centroids), batches):
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"])
    return run


def cluster(vectors: DataFrame, id: str = "vec_id", embedding: str = "embedding", dims: int = 64, k: int = 40, rounds: int = 5, scale: int = 256, seed: str = "2") -> DataFrame:
    """Cluster the vectors of exactly ``dims`` finite components, as whole numbers floor(scale * x).

    Centroids start as the ``k`` vectors of smallest lower-case hex sha256 of ``<seed>:<id>`` (equal ids: the smaller
    vector), numbered in that order; each round assigns all vectors to the nearest (squared distance, ties to the
    smaller number) and puts every centroid that has vectors at the floor of their mean; then all are assigned once
    more.  Returns one row per vector taken: (id, cluster, distance, cluster_inertia, inertia, centroid).

    Vectors that are null, of another length, or hold null or non-finite components are left out.  A vector with a
    null id is clustered but starts no centroid.  Fewer than ``k`` vectors give fewer centroids; none gives an empty
    result.  Repeated rows count each time; other columns are ignored.  Components beyond +-2^26 after scaling raise
    an error, since distances would leave 64 bits.  A task keeps ``k`` sums whatever it reads; the driver sees
    k x dims sums a round.
    """
    spark = prepare(vectors.sparkSession)
    held = F.col(embedding).cast("array<double>")
    fine = (F.size(held) == dims) & F.forall(held, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform(held, lambda x: F.floor(x * F.lit(float(scale))))
    safe = F.when(F.forall(whole, lambda x: F.abs(x) <= MOST), whole.cast("array<int>")).otherwise(
        F.raise_error(F.lit(f"a component is beyond {MOST} after scaling")).cast("array<int>"))
    rows = kept(vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(id).alias("id"), safe.alias("x")))
    kind = rows.schema["id"].dataType.simpleString()
    named = rows.where("id is not null").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256))
    first = [r["x"] for r in named.orderBy("h", "x").limit(k).collect()]  # k rows
    result = f"id {kind}, cluster int, distance long"
    if not first:
        return spark.createDataFrame([], f"{result}, cluster_inertia long, inertia long, centroid array<long>")
    centroids = np.array(first, np.int64)
    for _ in range(rounds):
        sums = rows.mapInArrow(releasing(_summed(centroids)), "cluster int, dim int, total long, n long")
        centroids = centroids.copy()
        for r in sums.groupBy("cluster", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # k x dims rows
            centroids[r["cluster"], r["dim"]] = r["total"] // r["n"]
    done = kept(rows.mapInArrow(releasing(_assigned(centroids)), result))
    inertia = {r["cluster"]: r["s"] for r in done.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    total = sum(inertia.values())
    known = spark.createDataFrame([(c, s, total, centroids[c].tolist()) for c, s in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return done.join(F.broadcast(known), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
