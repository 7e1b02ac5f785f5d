"""Approximate nearest neighbours by balanced posting lists.

Vectors are dealt to posting lists by their nearest centroids; a vector near a boundary is held by every list whose
centroid is nearly as close as the closest. Centroids are held in memory with a graph of their neighbours, which is
searched by a beam. A query reads the lists whose centroid distance is within a ratio of the nearest one's.
Equal vectors are one entry with its least ids, so thousands of copies cost what one does.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


@dataclass(frozen=True)
class Params:
    #: Vectors a list should hold; with max_lists this sets the number of lists.
    list_size: int = 100
    max_lists: int = 4096
    #: Bound of the sample that the centroids are fitted on. Every row is indexed.
    sample_rows: int = 20_000
    #: A vector is held by lists within (1 + closure) of its nearest centroid's distance, replicas at most.
    closure: float = 0.10
    replicas: int = 4
    #: A query reads lists within (1 + reach) of its nearest centroid's distance, probes at most.
    reach: float = 0.35
    probes: int = 96
    beam: int = 160
    degree: int = 24
    #: Vectors scored in one group; longer lists are split.
    chunk_rows: int = 4096


@dataclass(frozen=True)
class Centroids:
    points: np.ndarray
    links: np.ndarray
    entries: np.ndarray

    def nearest(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """For each unit vector up to beam lists by beam search over the graph, nearest first: (list or -1, distance)."""
        n, k = len(x), len(self.points)
        beam = min(beam, k)
        ids = np.full((n, beam), -1, np.int32)
        dist = np.full((n, beam), np.inf, np.float32)
        seen = np.zeros((n, k), bool)
        done = np.zeros((n, beam), bool)
        new = np.broadcast_to(self.entries, (n, len(self.entries)))
        fresh = np.ones(new.shape, bool)
        while True:
            d = np.where(fresh, 2 - 2 * np.einsum("nd,nmd->nm", x, self.points[new]), np.inf).astype(np.float32)
            np.put_along_axis(seen, new, True, axis=1)
            both = np.concatenate([dist, d], axis=1)
            order = np.argsort(both, axis=1, kind="stable")[:, :beam]
            ids = np.take_along_axis(np.concatenate([ids, new.astype(np.int32)], axis=1), order, axis=1)
            dist = np.take_along_axis(both, order, axis=1)
            done = np.take_along_axis(np.concatenate([done, np.zeros(new.shape, bool)], axis=1), order, axis=1) | np.isinf(dist)
            ids[np.isinf(dist)] = -1
            if done.all():
                return ids, np.sqrt(np.maximum(dist, 0))
            # the four nearest that were not yet followed
            todo = np.argsort(done, axis=1, kind="stable")[:, :4]
            open_ = ~np.take_along_axis(done, todo, axis=1)
            np.put_along_axis(done, todo, True, axis=1)
            new = self.links[np.where(open_, np.take_along_axis(ids, todo, axis=1), 0)].reshape(n, -1)
            fresh = ~np.take_along_axis(seen, new, axis=1) & np.repeat(open_, self.links.shape[1], axis=1)
            ordered = np.argsort(new, axis=1, kind="stable")
            twice = np.zeros(new.shape, bool)
            by = np.take_along_axis(new, ordered, axis=1)
            np.put_along_axis(twice, ordered[:, 1:], by[:, 1:] == by[:, :-1], axis=1)
            fresh &= ~twice


def fit(sample: np.ndarray, k: int, degree: int, seed: int = 7, rounds: int = 10) -> Centroids:
    """Balanced k-means over unit vectors (a longer list repels), then the graph of nearest centroids."""
    rng = np.random.default_rng(seed)
    x = np.unique(sample, axis=0)
    k = max(1, min(k, len(x)))
    c = x[rng.permutation(len(x))[:k]].copy()
    size = np.zeros(k)
    for _ in range(rounds):
        own = np.concatenate([np.argmax(part @ c.T - 0.05 * (size / max(1.0, len(x) / k) - 1).clip(-1, 4), axis=1) for part in np.array_split(x, -(-len(x) // 2048))])
        size = np.bincount(own, minlength=k).astype(float)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        empty = size == 0
        total[empty] = x[rng.integers(0, len(x), int(empty.sum()))]
        c = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)
    near = np.concatenate([np.argsort(-(part @ c.T), axis=1, kind="stable")[:, 1 : degree + 1] for part in np.array_split(c, -(-k // 1024))]) if k > 1 else np.zeros((1, 1), int)
    far = rng.integers(0, k, (k, 4))
    entries = np.unique(rng.integers(0, k, 16))
    return Centroids(c.astype(np.float32), np.concatenate([near, far], axis=1).astype(np.int64), entries)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of rows that take part: id set, all components finite, not all zero, as long as most vectors are."""
    v = F.col(vector_col).cast("array<double>")
    raw = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = raw.filter(finite & F.exists("v", lambda x: x != 0))
    widths = rows.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(1).collect()
    return rows.filter(F.size("v") == (widths[0].w if widths else 0))


def unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def stack(col: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in col]) if len(col) else np.zeros((0, 1))


def cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosine of row pairs in double precision, the same whatever stands in other rows."""
    # powers of two change no digit and keep squares within range
    q, v = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) for x in (q.astype(np.float64), v.astype(np.float64)))
    return (q * v).sum(axis=1) / (np.sqrt((q * q).sum(axis=1)) * np.sqrt((v * v).sum(axis=1)))


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, params: Params = Params(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found to each query, by cosine, without the row of the query's own id.

    Ties go to the smaller vec_id. Rows that do not take part (see usable) are neither queries nor candidates; a
    query with no other candidate has no rows; repeated ids are one candidate each. Empty tables give an empty result.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    least = Window.partitionBy("v").orderBy("id")
    few = rows.withColumn("n", F.row_number().over(least)).filter(F.col("n") <= k + 1)
    base = cut(few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    total = base.count()
    if total == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    part = F.pmod(F.xxhash64("v"), F.lit(1_000_000)) < int(min(1.0, 1.2 * params.sample_rows / total) * 1_000_000)
    picked = base.select("v").filter(part).limit(params.sample_rows).toPandas()
    sample = picked if len(picked) else base.select("v").limit(params.sample_rows).toPandas()
    index = spark.sparkContext.broadcast(fit(unit(stack(sample.v)), min(params.max_lists, -(-total // params.list_size)), params.degree))

    def deal(batches: Iterator[pd.DataFrame], beam: int, most: int, ratio: float) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                some = batch.iloc[at : at + 512]
                ids, dist = index.value.nearest(unit(stack(some.v)), beam)
                ids, dist = ids[:, :most], dist[:, :most]
                hit, which = np.nonzero((ids >= 0) & (dist <= (1 + ratio) * dist[:, :1] + 1e-6))
                out = some.iloc[hit].copy()
                out.insert(0, "list", ids[hit, which])
                yield out

    held = cut(base.mapInPandas(lambda it: deal(it, 4 * params.replicas, params.replicas, params.closure), "list int, v array<double>, ids array<long>"))
    sizes = held.groupBy("list").agg(F.ceil(F.count("*") / params.chunk_rows).cast("int").alias("chunks"))
    held = held.join(F.broadcast(sizes), "list").withColumn("chunk", F.pmod(F.xxhash64("v"), F.col("chunks")).cast("int"))

    asked = usable(queries, id_col, vector_col).select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    points = asked.groupBy("q").agg(F.min("query_id").alias("point"))
    probes = (
        points.select("point", F.col("q").alias("v"))
        .mapInPandas(lambda it: deal(it, params.beam, params.probes, params.reach), "list int, point long, v array<double>")
        .join(F.broadcast(sizes), "list")
        .select("list", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "point", F.col("v").alias("q"))
    )

    def best(lists: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(lists) and len(asks):
            v, q = stack(lists.v), stack(asks.q)
            uv = unit(v)
            top = min(len(v), k + 1)
            for at in range(0, len(q), 256):
                near = unit(q[at : at + 256]) @ uv.T
                # a margin for rounding in single precision; exact scores decide
                least = np.partition(near, len(v) - top, axis=1)[:, len(v) - top]
                a, b = np.nonzero(near >= least[:, None] - 1e-5)
                score = cosines(q[at + a], v[b])
                found = pd.DataFrame({"point": asks.point.to_numpy()[at + a], "id": lists.ids.to_numpy()[b], "score": score}).explode("id")
                found["id"] = found["id"].astype("int64")
                found = found.sort_values(["point", "score", "id"], ascending=[True, False, True], kind="stable")
                out.append(found.groupby("point", sort=False).head(k + 1))
        return pd.concat(out) if out else pd.DataFrame({"point": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    found = probes.groupBy("list", "chunk").cogroup(held.select("list", "chunk", "v", "ids").groupBy("list", "chunk")).applyInPandas(lambda asks, lists: best(lists, asks), "point long, id long, score double")
    once = found.groupBy("point", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("point").orderBy(F.desc("score"), "id")
    top = once.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    lists = top.groupBy("point").agg(F.array_sort(F.collect_list(F.struct("n", "id", "score"))).alias("found"))
    answered = asked.join(points, "q").select("query_id", "point").join(lists, "point")
    others = F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k)
    return answered.select("query_id", F.posexplode(others).alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
