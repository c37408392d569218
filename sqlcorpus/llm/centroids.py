"""Centroid clustering whose nearest centroids come from the threshold algorithm over sorted centroid lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors that a task walks at once.
WALK = 2048
#: Components up to this size have exact 64-bit squared distances; larger ones are compared as Python integers.
SMALL = 1 << 27
#: A component's integer lies between these bounds, so that sums of any number of rows fit 38 digits.
LARGEST = 1 << 62
LONG = (1 << 63) - 1


class CentroidLists:
    """For each dimension the centroids' values in ascending order, with the centroids' numbers."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids
        self.order = np.argsort(centroids, axis=0, kind="stable")
        self.values = np.take_along_axis(centroids, self.order, axis=0)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number, squared distance) of the nearest centroid of each row, the smaller number on ties; and the
        exact distances that this took.

        Every list is walked outward from the row's own value, one entry at a time, nearer side first. A centroid met
        for the first time gets its exact distance. One not yet met is in every list at the frontier or beyond, so its
        distance is at least the sum of the squared frontiers; a row is done when that sum exceeds its best distance.
        While they are equal, an unseen centroid with a smaller number may still tie, so the row goes on.
        """
        k, width = self.values.shape
        n, dims = len(x), np.arange(width)
        # Beyond any difference, and beyond any distance.
        far = 1 << 62 if x.dtype == np.int64 else 1 << 200
        above = np.empty((n, width), dtype=np.int64)
        for d in dims:
            above[:, d] = np.searchsorted(self.values[:, d], x[:, d])
        below = above - 1
        seen = np.zeros((n, k), dtype=bool)
        best, number = np.full(n, far, dtype=x.dtype), np.full(n, k)
        active, exact = np.arange(n), 0
        while len(active):
            low, high, own = below[active], above[active], x[active]
            down = np.where(low >= 0, own - self.values[np.maximum(low, 0), dims], far)
            up = np.where(high < k, self.values[np.minimum(high, k - 1), dims] - own, far)
            lower = down <= up
            met = np.zeros((len(active), k), dtype=bool)
            met[np.arange(len(active))[:, None], self.order[np.where(lower, low, high), dims]] = True
            below[active] -= lower
            above[active] += ~lower
            row, centroid = np.nonzero(met & ~seen[active])
            exact += len(row)
            distance = np.full((len(active), k), far, dtype=x.dtype)
            distance[row, centroid] = ((own[row] - self.centroids[centroid]) ** 2).sum(axis=1)
            nearest = distance.argmin(axis=1)
            found = distance[np.arange(len(active)), nearest]
            better = (found < best[active]) | ((found == best[active]) & (nearest < number[active]))
            best[active[better]], number[active[better]] = found[better], nearest[better]
            seen[active] |= met
            frontier = (np.where(lower, down, up) ** 2).sum(axis=1)
            going = (frontier <= best[active]) & ~seen[active].all(axis=1)
            active = active[going.astype(bool)]
        return number, best, exact


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column of ``width`` integers a row; as Python integers if 64 bits could overflow."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return x.astype(object) if len(x) and max(int(x.max()), -int(x.min())) > SMALL else x


def fitting(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and centroids in one type that holds their distances."""
    large = x.dtype == object or max(map(abs, centroids.ravel().tolist())) > SMALL
    kind = object if large else np.int64
    return x.astype(kind), centroids.astype(kind)


def walk(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, width: int):
    """(batch, rows as a matrix, their centroids, their squared distances) for small batches."""
    lists: dict[bool, CentroidLists] = {}
    for batch in batches:
        for start in range(0, batch.num_rows, WALK):
            part = batch.slice(start, WALK)
            x, c = fitting(matrix(part.column("_v"), width), centroids)
            held = lists.setdefault(x.dtype == object, CentroidLists(c))
            number, distance, _ = held.nearest(x)
            yield part, x, number, distance


def cluster_vectors(
    vectors: DataFrame, workspace, n_clusters: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024,
    seed: str = "3", id_col: str = "vec_id", vector_col: str = "embedding",
) -> tuple[DataFrame, list[list[int]]]:
    """(id, cluster, distance) of every vector that is kept, and the final centroids.

    Kept are vectors of ``width`` components, none null or non-finite; a component x becomes floor(``scale`` * x) in
    double precision. The first centroids are the vectors with the smallest sha256 of ``seed:id``, in that order. In each
    round vectors go to their nearest centroid by squared distance, ties to the smaller number, and centroids become
    floored means; one without vectors stays. A last pass assigns once more.

    A round reads the stored integers once. A task sums its vectors by cluster, and only sums are shuffled, so a
    cluster that holds most vectors costs no more than others; the driver sees ``n_clusters`` times ``width`` numbers.

    Other vectors (null, empty, short, long, with a null or non-finite component) are in no row of the result. A null
    id counts as empty text; rows that share an id are vectors of their own, ordered by their components where both
    could start. With fewer kept vectors than clusters each starts a centroid; without any the result is empty and so
    are the centroids. Centroids that start equal leave all but the first of them empty. Integers are cut at 2^62 and
    a distance beyond 2^63 - 1 counts as that in the result, but not when distances are compared. Extra columns are
    not read, whatever their names.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    v = F.col("_v")
    rows = vectors.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("_v"))
    whole = F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False))
    scaled = F.transform(v, lambda c: F.least(F.greatest(
        F.floor(c * F.lit(float(scale))), F.lit(-LARGEST)), F.lit(LARGEST)).cast("long"))
    kept = workspace.table(rows.where((F.size(v) == width) & whole).select("_id", scaled.alias("_v")), "integers")

    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = kept.select(key.alias("_key"), "_v").orderBy("_key", "_v").limit(n_clusters).collect()
    centroids = [list(row["_v"]) for row in first]
    if not centroids:
        return spark.createDataFrame([], f"`{id_col}` {kind}, cluster int, distance long"), []

    def totals(now: list[list[int]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            k = len(now)
            count, total = [0] * k, np.zeros((k, width), dtype=object)
            for _, x, number, _ in walk(batches, np.array(now, dtype=object), width):
                for c in np.unique(number).tolist():
                    chosen = x[number == c]
                    count[c] += len(chosen)
                    # Sums of one small batch fit 64 bits whenever its distances do.
                    total[c] += chosen.sum(axis=0).astype(object)
            for c in range(k):
                if count[c]:
                    yield pa.RecordBatch.from_pydict({
                        "_cluster": pa.array([c] * width, pa.int32()), "_dim": pa.array(range(width), pa.int32()),
                        "_n": pa.array([count[c]] * width, pa.int64()),
                        "_sum": pa.array([_decimal(s) for s in total[c].tolist()], pa.decimal128(38, 0))})
        return run

    for _ in range(rounds):
        partial = kept.select("_v").mapInArrow(totals(centroids), "_cluster int, _dim int, _n long, _sum decimal(38,0)")
        summed = partial.groupBy("_cluster", "_dim").agg(F.sum("_n").alias("_n"), F.sum("_sum").alias("_sum"))
        moved = [list(c) for c in centroids]
        for row in summed.collect():
            moved[row["_cluster"]][row["_dim"]] = int(row["_sum"]) // row["_n"]
        if moved == centroids:
            break  # every further round would repeat this one
        centroids = moved

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, number, distance in walk(batches, np.array(centroids, dtype=object), width):
            yield pa.RecordBatch.from_arrays([
                part.column("_id"), pa.array(number, pa.int32()),
                pa.array([min(d, LONG) for d in distance.tolist()], pa.int64())], names=[id_col, "cluster", "distance"])

    assigned = kept.mapInArrow(assign, f"`{id_col}` {kind}, cluster int, distance long")
    return workspace.table(assigned, "assigned"), centroids


def _decimal(value: int):
    from decimal import Decimal

    return Decimal(value)


def with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``assigned`` with cluster_inertia, inertia (distances summed over the cluster and over all; cut at 2^63 - 1) and
    centroid_sha256, the hex digest of the centroid's components as decimal numbers joined by commas."""
    import hashlib

    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    sums = {row["cluster"]: int(row["s"]) for row in assigned.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row a centroid
    facts = [(c, min(sums.get(c, 0), LONG), min(sum(sums.values()), LONG), d) for c, d in enumerate(digests)]
    table = assigned.sparkSession.createDataFrame(
        facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster").select(*assigned.columns, *table.columns[1:])
