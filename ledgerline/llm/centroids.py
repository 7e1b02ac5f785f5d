"""Centroid clustering of integer vectors, exact, by a PCA-rotated filter.

Vectors are rotated once into the axes of their covariance; of each the first coordinates are stored and the norm of the
rest. For a centroid turned the same way, the distance of the first coordinates plus the squared difference of the two
norms is never more than the whole distance, so most centroids are ruled out by a short product. Those that are not are
measured in integers, which alone decide: the rotation changes the work, never a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Components stay below this, so that a squared distance of 64 of them fits a long.
LARGEST = 1 << 25
#: Pairs of vector and centroid measured at a time.
PAIRS = 8192


@dataclass(frozen=True)
class Params:
    k: int = 40
    rounds: int = 5
    width: int = 64
    #: Rotated coordinates kept for the bound.
    lead: int = 16
    #: Seeds are the vectors of least SHA-256 of `<salt>:<id>`.
    salt: str = "2"


def integers(vector: Column) -> Column:
    """floor(256 * x) of each component x, as double; a component too large to be measured in a long stops the query."""
    scaled = F.transform(vector.cast("array<double>"), lambda x: F.floor(x * 256.0).cast("long"))
    return F.when(F.exists(scaled, lambda x: F.abs(x) >= LARGEST), F.raise_error(F.lit(f"a component times 256 is {LARGEST} or more")).cast("array<int>")).otherwise(scaled.cast("array<int>"))


def whole(vector: Column) -> Column:
    """No component of the vector is null, infinite or not a number (null for a null vector)."""
    return F.forall(vector.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of a list column of one width."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in chunks if len(c)]
    return np.concatenate(flat).reshape(len(column), width) if flat else np.zeros((len(column), width), np.int64)


@dataclass(frozen=True)
class Model:
    """Centroids in integers and as the filter sees them."""

    points: np.ndarray
    lead: np.ndarray
    rest: np.ndarray

    @staticmethod
    def of(points: np.ndarray, axes: np.ndarray, lead: int) -> Model:
        turned = points.astype(np.float64) @ axes
        return Model(points, turned[:, :lead], np.linalg.norm(turned[:, lead:], axis=1))

    def nearest(self, x: np.ndarray, lead: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of each vector's nearest centroid, ties to the smaller number."""
        n, k = len(x), len(self.points)
        sizes = (lead * lead).sum(1)[:, None] + (self.lead * self.lead).sum(1)[None]
        bound = sizes - 2 * lead @ self.lead.T + (rest[:, None] - self.rest[None]) ** 2
        # rounding of doubles, far more than it can be
        bound -= 1e-9 * (sizes + rest[:, None] ** 2 + self.rest[None] ** 2) + 1e-3
        rows = np.arange(n)
        first = bound.argmin(1)
        best = self.measure(x, rows, first)
        found = np.full((n, k), np.iinfo(np.int64).max)
        i, j = np.nonzero(bound <= best[:, None])
        found[i, j] = self.measure(x, i, j)
        own = found.argmin(1)
        return own, found[rows, own]

    def measure(self, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.empty(len(i), np.int64)
        for at in range(0, len(i), PAIRS):
            d = x[i[at : at + PAIRS]].astype(np.int64) - self.points[j[at : at + PAIRS]]
            out[at : at + PAIRS] = np.einsum("nd,nd->n", d, d)
        return out


def _axes(rows: DataFrame, width: int) -> np.ndarray:
    """Axes of the rows' covariance as columns, the widest first: one task adds up its moments, Spark those of all tasks."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width + 1))
        for b in batches:
            x = np.concatenate([np.ones((b.num_rows, 1)), matrix(b.column(0), width)], axis=1)
            total += x.T @ x
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(width + 1), pa.int32()), "m": pa.array(list(total), pa.list_(pa.float64()))})

    found = rows.select("ints").mapInArrow(moments, "i int, m array<double>").select("i", F.posexplode("m").alias("j", "m")).groupBy("i", "j").agg(F.sum("m").alias("m")).collect()
    total = np.zeros((width + 1, width + 1))
    for r in found:
        total[r.i, r.j] = r.m
    mean = total[0, 1:] / max(1.0, total[0, 0])
    _, axes = np.linalg.eigh(total[1:, 1:] / max(1.0, total[0, 0]) - np.outer(mean, mean))
    return axes[:, ::-1]


def cluster(vectors: DataFrame, params: Params = Params(), id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(assigned, centroids): (vec_id, cluster, distance) of every vector that takes part, and (cluster, centroid,
    centroid_sha256) of each centroid at the end.

    Vectors of another width, null ones and those with a null or non-finite component take no part. Each round assigns
    every vector to the nearest centroid (squared Euclidean distance, ties to the smaller number) and replaces every
    centroid that has vectors by their componentwise floor(sum / count). Repeated rows are vectors each; as seeds, equal ids
    go by their components and null ids come last. With fewer vectors than k there are as many centroids as vectors; an
    empty table gives two empty results. Other columns are left out whatever their names.

    A round is one scan of the written, rotated vectors: tasks add up their own vectors, so a cluster that holds a third of
    all rows is no hot key, and k x width sums come back. Only these, the seeds and the covariance pass the driver.
    """
    spark, width = vectors.sparkSession, params.width
    usable = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).filter((F.size("v") == width) & whole(F.col("v")))
    ints = usable.select("vec_id", integers(F.col("v")).alias("ints"))
    seeds = ints.withColumn("at", F.sha2(F.concat(F.lit(f"{params.salt}:"), F.col("vec_id").cast("string")), 256)).orderBy(F.asc_nulls_last("at"), "ints").limit(params.k).collect()
    told = "cluster int, centroid array<long>, centroid_sha256 string"
    if not seeds:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), spark.createDataFrame([], told)
    axes = _axes(ints, width)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            turned = matrix(b.column("ints"), width).astype(np.float64) @ axes
            lead = pa.FixedSizeListArray.from_arrays(pa.array(turned[:, : params.lead].ravel()), params.lead).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("ints"), lead, pa.array(np.linalg.norm(turned[:, params.lead :], axis=1))], ["vec_id", "ints", "lead", "rest"])

    rows = cut(ints.mapInArrow(turn, "vec_id long, ints array<int>, lead array<double>, rest double"))

    def nearest(b: pa.RecordBatch, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = matrix(b.column("ints"), width)
        return x, *model.nearest(x, matrix(b.column("lead"), params.lead), b.column("rest").to_numpy())

    points = np.array([r.ints for r in seeds], np.int64)
    for _ in range(params.rounds):
        model = Model.of(points, axes, params.lead)

        def sums(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
            count, total = np.zeros(len(model.points), np.int64), np.zeros(model.points.shape, np.int64)
            for b in batches:
                x, own, _ = nearest(b, model)
                count += np.bincount(own, minlength=len(count))
                np.add.at(total, own, x)
            held = np.flatnonzero(count)
            yield pa.RecordBatch.from_pydict({"cluster": pa.array(held, pa.int32()), "n": pa.array(count[held]), "s": pa.array(list(total[held]), pa.list_(pa.int64()))})

        parts = rows.mapInArrow(sums, "cluster int, n long, s array<long>").select("cluster", "n", F.posexplode("s").alias("at", "s"))
        points = points.copy()
        for r in parts.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
            points[r.cluster, r["at"]] = int(r.s) // r.n
    model = Model.of(points, axes, params.lead)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, own, distance = nearest(b, model)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(own, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    said = [(n, p, hashlib.sha256(",".join(map(str, p)).encode()).hexdigest()) for n, p in enumerate(points.tolist())]
    return cut(rows.mapInArrow(deal, "vec_id long, cluster int, distance long")), spark.createDataFrame(said, told)


def digest(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """Each vector with its cluster's and the whole inertia; what is broadcast has a row for each centroid."""
    sums = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    every = assigned.agg(F.sum("distance").alias("inertia"))
    known = centroids.select("cluster", "centroid_sha256").join(F.broadcast(sums), "cluster").join(F.broadcast(every))
    return assigned.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
