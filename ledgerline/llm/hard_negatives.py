"""Hard negatives by rotated one-bit codes.

What a vector has beside the nearest of a few centers is turned by one random rotation and stored as the signs of its
coordinates, its norm and its alignment: the product with its own code taken as a unit vector. What the code misses is at right angles to it, of known length. A
query in small integers meets a code by bit counts; its product with that vector is alignment times the estimate, give or
take the query's rounding and, by Cauchy and Schwarz, the length missed times what of the query lies off the code. The
interval is certain, so a row is passed over only if its interval cannot matter, and all others are scored in integers.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .centroids import integers, matrix, whole
from .common import cut

SCORED = "anchor long, part int, vec_id long, rid long, score long"


@dataclass(frozen=True)
class Params:
    positives: int = 5
    negatives: int = 3
    #: A negative's score lies between these hundredths of the positive's.
    least: int = 50
    most: int = 95
    #: Bits of a query's coordinate.
    bits: int = 6
    #: Rows and anchors that one task compares.
    block_rows: int = 4096
    block_anchors: int = 2048
    #: Rows drawn as centers, at most.
    centers: int = 256
    seed: int = 12


@lru_cache(maxsize=4)
def rotation(width: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as words of 64."""
    octets = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(np.pad(octets, ((0, 0), (0, -octets.shape[1] % 8)))).view(np.uint64)


@dataclass(frozen=True)
class Codes:
    """Rows of one width. near: which of centers, integer vectors, a row was coded beside."""

    words: np.ndarray
    norm: np.ndarray
    align: np.ndarray
    near: np.ndarray
    centers: np.ndarray

    @staticmethod
    def of(x: np.ndarray, centers: np.ndarray, seed: int) -> Codes:
        width, c = x.shape[1], centers.astype(np.float64)
        near = ((c * c).sum(1)[None] - 2 * x.astype(np.float64) @ c.T).argmin(1)
        turned = (x - centers[near]).astype(np.float64) @ rotation(width, seed)
        return Codes(_packed(turned >= 0), np.sqrt((turned * turned).sum(1)), np.abs(turned).sum(1) / np.sqrt(max(1, width)), near, centers)

    def bounds(self, q: np.ndarray, seed: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) for the product of every row with every query: arrays of queries x rows."""
        width = q.shape[1]
        turned = q.astype(np.float64) @ rotation(width, seed)
        size = np.sqrt((turned * turned).sum(1))[:, None]
        low = turned.min(1, initial=0)[:, None]
        step = np.maximum((turned.max(1, initial=0)[:, None] - low) / ((1 << bits) - 1), 1e-12)
        u = np.rint((turned - low) / step).astype(np.int64)
        error = np.sqrt(((turned - low - step * u) ** 2).sum(1))[:, None]
        count = lambda words: np.bitwise_count(self.words[None] & words[:, None]).sum(2, dtype=np.int64)
        weighed = sum((count(_packed((u >> b & 1).astype(bool))) << b for b in range(bits)), np.zeros((len(q), len(self.words)), np.int64))
        ones = np.bitwise_count(self.words).sum(1, dtype=np.int64)[None]
        # product of the code, a unit vector, with the rounded query
        met = (low * (2 * ones - width) + step * (2 * weighed - u.sum(1)[:, None])) / np.sqrt(max(1, width))
        missed = np.sqrt(np.maximum(self.norm**2 - self.align**2, 0))[None]
        beside = np.sqrt(np.maximum(size**2 - np.maximum(np.abs(met) - error, 0) ** 2, 0))
        half = self.align[None] * error + missed * beside + 1e-6 * (self.norm[None] * size) + 1e-6
        met = self.align[None] * met + (q @ self.centers.T)[:, self.near]
        return met - half, met + half


class Centers:
    """Distinct vectors, most at most, and the zero vector for each width."""

    def __init__(self, drawn: list[list[int]], most: int):
        self.by_width: dict[int, list] = {}
        for v in list(dict.fromkeys(map(tuple, drawn)))[:most]:
            self.by_width.setdefault(len(v), []).append(v)

    def of(self, width: int) -> np.ndarray:
        held = [(0,) * width, *self.by_width.get(width, [])]
        return np.array(held, np.int64).reshape(len(held), width)


@dataclass(frozen=True)
class Coded:
    """rows: (rid, vec_id, label, width, ints, near, words, norm, align), written once."""

    rows: DataFrame
    centers: Centers


def prepare(vectors: DataFrame, params: Params = Params(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", changed_every: int = 7, labels: int = 10) -> Coded:
    """Every row that takes part with its code, and the centers, a bounded draw by hash of id and components.

    Rows with a null label or id, a null vector or one with a null or non-finite component take no part. Where changed_every
    is set, the label of every id it divides becomes (label + 1) % labels.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v"))
    rows = rows.filter("vec_id is not null and label is not null").filter(whole(F.col("v")))
    label = F.when(F.col("vec_id") % changed_every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")) if changed_every else F.col("label")
    seed = params.seed

    def encode(batches):
        for b in batches:
            width, ints = b.column("width").to_numpy(), b.column("ints")
            for w in np.unique(width):
                at = np.flatnonzero(width == w)
                some = b.take(pa.array(at))
                c = Codes.of(matrix(some.column("ints"), int(w)), centers.of(int(w)), seed)
                yield pa.RecordBatch.from_arrays([some.column("vec_id"), some.column("label"), some.column("width"), some.column("ints"), pa.array(c.near, pa.int32()), pa.array(list(c.words.view(np.int64)), pa.list_(pa.int64())), pa.array(c.norm), pa.array(c.align)], ["vec_id", "label", "width", "ints", "near", "words", "norm", "align"])

    ready = rows.select("vec_id", label.alias("label"), F.size("v").alias("width"), integers(F.col("v")).alias("ints"))
    drawn = ready.orderBy(F.xxhash64("vec_id", "ints"), "ints").select("ints").limit(4 * params.centers).collect()
    centers = Centers([r.ints for r in drawn], params.centers)
    coded = ready.mapInArrow(encode, "vec_id long, label long, width int, ints array<int>, near int, words array<long>, norm double, align double")
    return Coded(cut(coded.withColumn("rid", F.monotonically_increasing_id())), centers)


def _blocks(rows: DataFrame, anchors: DataFrame, params: Params, extra: list[str]):
    """Rows and anchors of one width, each dealt by its number to blocks; every pair of blocks is one group."""
    count = lambda df, size, name: df.groupBy("width").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    sizes = count(rows, params.block_rows, "row_blocks").join(count(anchors, params.block_anchors, "anchor_blocks"), "width")
    deal = lambda df, own, other: df.join(sizes, "width").withColumn(own[:-1], F.pmod(F.xxhash64("rid"), F.col(own)).cast("int")).withColumn(other[:-1], F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
    key = ["width", "anchor_block", "row_block"]
    left = deal(anchors, "anchor_blocks", "row_blocks").select(*[F.col(c).alias(c) for c in (*key, "rid", "label", "ints", *extra)])
    right = deal(rows, "row_blocks", "anchor_blocks").select(*key, "rid", "vec_id", "label", "ints", "near", "words", "norm", "align")
    return left.groupBy(*key).cogroup(right.groupBy(*key))


def _compare(params: Params, centers: Centers, choose):
    """Function of a pair of blocks. choose(rows that may be, lower, upper, positives' scores) tells which rows are scored; of
    these the best few are returned for each positive, or for the anchor itself while it has none."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], [], [], []]
        if left.num_rows and right.num_rows:
            width = int(left.column("width")[0].as_py())
            x, q = matrix(right.column("ints"), width).astype(np.int64), matrix(left.column("ints"), width).astype(np.int64)
            codes = Codes(matrix(right.column("words"), -(-width // 64)).view(np.uint64), right.column("norm").to_numpy(), right.column("align").to_numpy(), right.column("near").to_numpy(), centers.of(width))
            rid, vec, label = (right.column(c).to_numpy() for c in ("rid", "vec_id", "label"))
            anchor, own = left.column("rid").to_numpy(), left.column("label").to_numpy()
            parts = left.column("scores").to_pylist() if "scores" in left.column_names else [None] * len(q)
            for at in range(0, len(q), 64):
                lower, upper = codes.bounds(q[at : at + 64], params.seed, params.bits)
                for n in range(len(lower)):
                    a = at + n
                    mine = (label == own[a]) & (rid != anchor[a]) if parts[a] is None else label != own[a]
                    open_ = np.flatnonzero(choose(mine, lower[n], upper[n], parts[a]))
                    score = x[open_] @ q[a]
                    for part, keep, most in ((0, slice(None), params.positives),) if parts[a] is None else ((p, (params.least * s <= 100 * score) & (100 * score <= params.most * s), params.negatives) for p, s in enumerate(parts[a])):
                        which, s = open_[keep], score[keep]
                        first = np.lexsort((rid[which], vec[which], -s))[:most]
                        for column, v in zip(out, (np.full(len(first), anchor[a]), np.full(len(first), part), vec[which[first]], rid[which[first]], s[first]), strict=True):
                            column.append(v)
        whole_ = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
        return pa.table({"anchor": pa.array(whole_[0], pa.int64()), "part": pa.array(whole_[1], pa.int32()), "vec_id": pa.array(whole_[2], pa.int64()), "rid": pa.array(whole_[3], pa.int64()), "score": pa.array(whole_[4], pa.int64())})

    return run


def _nth(values: np.ndarray, n: int) -> float:
    """The n-th largest; nothing is sure yet where there are fewer."""
    return np.partition(values, len(values) - n)[len(values) - n] if len(values) >= n else -np.inf


def mine(coded: Coded, anchors: DataFrame, params: Params = Params()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    coded: what prepare made; anchors: those of its rows to mine for. A score is the integer inner product with the anchor,
    larger first, ties to the smaller vec_id. Positives are the first other rows of the anchor's label; for each, the first
    rows of another label whose score lies between its hundredths are returned (all, if fewer). A row meets vectors of its
    own width alone. Repeated rows are rows each: a copy of the anchor is one of its positives. Empty tables, anchors with no
    positive and positives with no negative give no rows.

    The result is exact. Anchors meet all rows in blocks: a task compares block_anchors with block_rows, whatever their
    labels, and returns its own best few, so a label or a vector that a third of the rows share is no hot key.
    """

    def best(mine_, lower, upper, _):
        return mine_ & (upper >= _nth(lower[mine_], params.positives))

    def within(mine_, lower, upper, scores):
        keep = np.zeros(len(mine_), bool)
        for s in scores:
            inside = mine_ & (100 * lower >= params.least * s) & (100 * upper <= params.most * s)
            keep |= (100 * upper >= params.least * s) & (100 * lower <= params.most * s) & (upper >= _nth(lower[inside], params.negatives))
        return keep & mine_

    def merged(found: DataFrame, most: int) -> DataFrame:
        order = Window.partitionBy("anchor", "part").orderBy(F.desc("score"), "vec_id", "rid")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)

    rows, centers = coded.rows, coded.centers
    named = anchors.select("rid", "vec_id", "label", "width", "ints")
    positives = cut(merged(_blocks(rows, named, params, []).applyInArrow(_compare(params, centers, best), SCORED), params.positives).select(F.col("anchor").alias("rid"), (F.col("rank") - 1).cast("int").alias("part"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    told = positives.groupBy("rid").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "positive_score"))), lambda p: p["positive_score"]).alias("scores"))
    negatives = merged(_blocks(rows, named.join(told, "rid"), params, ["scores"]).applyInArrow(_compare(params, centers, within), SCORED), params.negatives)
    found = negatives.select(F.col("anchor").alias("rid"), "part", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    ids = named.select("rid", F.col("vec_id").alias("anchor_id"))
    return found.join(positives, ["rid", "part"]).join(ids, "rid").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
