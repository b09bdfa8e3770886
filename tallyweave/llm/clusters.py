"""Centroid clustering in exact integers, with centroids ruled out in PCA-rotated coordinates.

Vectors are turned into integers. A rotation to their principal axes is computed from the sums of all of them; of each
vector the leading rotated coordinates and the norm of the rest are stored beside it. For a vector x and a centroid c
the squared distance is at least that of the leading coordinates plus (norm of x's rest - norm of c's rest) squared. A
task works out these bounds for a batch of vectors and all centroids, measures the vector against the centroid with the
least bound in integers, and then against each centroid whose bound, less what rounding may add, doesn't exceed the best
distance so far. Sums per cluster are added up in tasks, then over tasks, as exact decimals.

How many centroids the bounds rule out depends on the vectors: where a few axes hold most of the variance nearly all but
the nearest; where all axes are alike, as in random unit vectors, few, and the assignment is then a full comparison.

Defined results: vectors that are null, of another length than ``dims``, or hold a null or non-finite component take no
part. Each row is a vector, repeated ones and equal vec_ids too; among equal hashes the smaller vector starts first, and
a null vec_id counts as an empty text there. Scaled components beyond +-2^27 count as +-2^27, so that every distance
fits 64 bits; sums of distances stop at 2^63 - 1. With fewer vectors than ``k`` each is a centroid; an empty table gives
no rows. Only vec_id and embedding are read; ``k`` centroids go with each job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Leading rotated coordinates that are stored, and the largest component.
LEADING, LARGEST = 16, 1 << 27
#: Vectors of a piece of work.
ROWS = 4096


def quantised(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """(vec_id, v: array<long>) with floor(scale * x) of the vectors that take part."""
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            batch = batch.filter(pa.compute.fill_null(pa.compute.equal(pa.compute.list_value_length(lists), dims), False))
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
            good = np.isfinite(x).all(axis=1)
            with np.errstate(over="ignore"):
                q = np.clip(np.floor(x[good] * scale), -LARGEST, LARGEST).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), _lists(q)], names=["vec_id", "v"])

    rows = vectors.select("vec_id", "embedding")
    if rows.schema["embedding"].dataType.simpleString() not in ("array<float>", "array<double>"):
        rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, f"vec_id {kind}, v array<bigint>")


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))


def _rows(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            yield batch.slice(lo, ROWS)


def rotation(vectors: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and principal axes, by falling variance as columns, of all vectors (v).

    Any orthonormal axes keep the bounds valid, so doubles do. Tasks send one number for each two dimensions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims + 1, dims + 1))
        for batch in _cut(batches):
            x = np.c_[_rows(batch.column(0), dims).astype(np.float64), np.ones(batch.num_rows)]
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.reshape(-1))], names=["i", "s"])

    sums = vectors.select("v").mapInArrow(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).toPandas().sort_values("i")["s"].to_numpy()
    if not len(sums) or sums[-1] == 0:
        return np.zeros(dims), np.eye(dims)
    sums = sums.reshape(dims + 1, dims + 1) / sums[-1]
    mean = sums[-1, :-1]
    _, axes = np.linalg.eigh(sums[:-1, :-1] - np.outer(mean, mean))
    return mean, axes[:, ::-1]


def coordinates(x: np.ndarray, mean: np.ndarray, axes: np.ndarray, leading: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading rotated coordinates of vectors, and the norm of what they leave."""
    y = (x - mean) @ axes
    return y[:, :leading], np.sqrt((y[:, leading:] ** 2).sum(axis=1))


def nearest(x: np.ndarray, lead: np.ndarray, rest: np.ndarray, c: np.ndarray, c_lead: np.ndarray, c_rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid of each vector, the smallest of equal ones, its squared distance, and how many were measured."""
    bound = ((lead**2).sum(axis=1) + rest**2)[:, None] + (c_lead**2).sum(axis=1) + c_rest**2
    slack = 1e-9 * bound + 1e-6  # more than rounding can add to a bound
    bound -= 2 * (lead @ c_lead.T) + 2 * np.outer(rest, c_rest) + slack
    i = np.arange(len(x))
    first = bound.argmin(axis=1)
    best, at = ((x - c[first]) ** 2).sum(axis=1), first
    measured = len(x)
    for k in range(len(c)):
        row = np.flatnonzero((bound[:, k] <= best) & (first != k))
        measured += len(row)
        far = ((x[row] - c[k]) ** 2).sum(axis=1)
        closer = (far < best[row]) | (far == best[row]) & (k < at[row])
        best[row[closer]], at[row[closer]] = far[closer], k
    return at[i], best, measured


def started(vectors: DataFrame, k: int, seed: int, dims: int) -> np.ndarray:
    """The ``k`` vectors whose ids hash lowest, in that order."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r.v for r in vectors.select(mark.alias("mark"), "v").orderBy("mark", "v").limit(k).collect()], np.int64).reshape(-1, dims)  # ``k`` rows at the most


def clustered(vectors: DataFrame, k: int, rounds: int, dims: int, scale: int, seed: int, leading: int = LEADING) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every vector after ``rounds`` rounds, and the final centroids."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    leading = min(leading, dims)
    whole = stored(quantised(vectors, dims, scale), "cluster-vectors")
    centroids = started(whole, k, seed, dims)
    mean, axes = rotation(whole, dims)

    def rotated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut(batches):
            lead, rest = coordinates(_rows(batch.column(1), dims).astype(np.float64), mean, axes, leading)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(lead), pa.array(rest)], names=["vec_id", "v", "lead", "rest"])

    rows = stored(whole.mapInArrow(rotated, f"vec_id {kind}, v array<bigint>, lead array<double>, rest double"), "cluster-rotated")

    def assigned(batches: Iterator[pa.RecordBatch], c: np.ndarray) -> Iterator[tuple]:
        c_lead, c_rest = coordinates(c.astype(np.float64), mean, axes, leading)
        for batch in _cut(batches):
            x = _rows(batch.column(1), dims)
            at, far, _ = nearest(x, _rows(batch.column(2), leading), batch.column(3).to_numpy(), c, c_lead, c_rest)
            yield batch, x, at, far

    def sums_by(c: np.ndarray):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(c), dims + 1), np.int64)
            for done, (_, x, at, _) in enumerate(assigned(batches, c), 1):
                order = np.argsort(at, kind="stable")
                used, start = np.unique(at[order], return_index=True)
                total[used] += np.add.reduceat(np.c_[x, np.ones(len(x), np.int64)][order], start, axis=0)
                if done % 1024 == 0:  # before a sum could leave 64 bits
                    yield sums(total)
                    total[:] = 0
            yield sums(total)

        return run

    def sums(total: np.ndarray) -> pa.RecordBatch:
        used = np.flatnonzero(total[:, -1])
        cells = np.arange(dims + 1)
        arrays = [np.repeat(used, len(cells)), np.tile(cells, len(used)), total[used].reshape(-1)]
        return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)) for a in arrays], names=["cluster", "cell", "s"])

    for _ in range(rounds if len(centroids) else 0):
        per = rows.mapInArrow(sums_by(centroids), "cluster long, cell long, s long").groupBy("cluster", "cell").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
        found: dict[int, dict[int, int]] = {}
        for r in per.collect():  # a row for each centroid and dimension
            found.setdefault(r.cluster, {})[r.cell] = int(r.s)
        centroids = centroids.copy()
        for cluster, cells in found.items():
            centroids[cluster] = [cells[d] // cells[dims] for d in range(dims)]

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, at, far in assigned(batches, centroids):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at.astype(np.int32)), pa.array(far)], names=["vec_id", "cluster", "distance"])

    return stored(rows.mapInArrow(final, f"vec_id {kind}, cluster int, distance long"), "cluster-final"), centroids


def cluster_table(vectors: DataFrame, k: int, rounds: int, dims: int, scale: int, seed: int) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector."""
    out, centroids = clustered(vectors, k, rounds, dims, scale, seed)
    spark = vectors.sparkSession
    names = spark.createDataFrame([(i, ",".join(map(str, c.tolist()))) for i, c in enumerate(centroids)], "cluster int, components string")
    capped = lambda c: F.least(c, F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("bigint")
    per = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    whole = out.agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("t"))
    per = per.join(names, "cluster").crossJoin(whole)  # one row
    per = per.select("cluster", capped(F.col("s")).alias("cluster_inertia"), capped(F.col("t")).alias("inertia"), F.sha2("components", 256).alias("centroid_sha256"))
    return out.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # ``k`` rows at the most
