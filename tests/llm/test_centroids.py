import hashlib

import numpy as np
import pytest

from ledgerline.llm import centroids as ct

SCHEMA = "vec_id long, embedding array<float>, cluster string, lead int"


def brute(rows, p):
    kept = [(i, np.floor(256 * np.array(v, np.float32).astype(np.float64)).astype(np.int64)) for i, v, *_ in rows if v is not None and len(v) == p.width and all(x is not None and np.isfinite(np.float64(x)) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{p.salt}:{r[0]}".encode()).hexdigest(), r[1].tolist()))
    points = [r[1].tolist() for r in order[: p.k]]
    near = lambda x: min((sum((int(a) - b) ** 2 for a, b in zip(x, c, strict=True)), n) for n, c in enumerate(points))
    for _ in range(p.rounds):
        own = [near(x)[1] for _, x in kept]
        points = [[sum(int(kept[r][1][d]) for r in held) // len(held) for d in range(p.width)] if (held := [r for r, c in enumerate(own) if c == n]) else points[n] for n in range(len(points))]
    last = [near(x) for _, x in kept]
    total = sum(d for d, _ in last)
    per = {n: sum(d for d, c in last if c == n) for n in range(len(points))}
    said = {n: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for n, c in enumerate(points)}
    return sorted(((i, c, d, per[c], total, said[c]) for (i, _), (d, c) in zip(kept, last, strict=True)), key=repr)


def clustered(spark, rows, p):
    return sorted(map(tuple, ct.digest(*ct.cluster(spark.createDataFrame(rows, SCHEMA).repartition(3), p)).collect()), key=repr)


@pytest.mark.parametrize(("width", "k", "lead"), [(8, 6, 3), (64, 12, 16), (4, 5, 4)])
def test_equals_brute_force(spark, width, k, lead):
    rng = np.random.default_rng(width)
    v = rng.standard_normal((160, width)) * 0.3 + (np.arange(160) % 3)[:, None] * 0.4
    v[20:80] = v[5]
    rows = [(int(i), [float(x) for x in v[i]], "", 0) for i in range(160)]
    rows += [(7, [0.25] * width, "", 0), (None, [0.5] * width, "", 0), (300, None, "", 0), (301, [0.1], "", 0), (302, [None] * width, "", 0), (303, [float("inf")] * width, "", 0), (304, [float("nan")] * width, "", 0), rows[3], rows[3]]
    p = ct.Params(k=k, width=width, lead=lead)
    want = brute(rows, p)
    assert len(want) == 164 and clustered(spark, rows, p) == want


def test_few_vectors_and_none(spark):
    p = ct.Params(k=40, width=2, lead=1)
    assert clustered(spark, [], p) == []
    rows = [(1, [1.0, 2.0], "", 0), (2, [1.0, 2.0], "", 0), (3, [-1.0, 0.3], "", 0)]
    assert clustered(spark, rows, p) == brute(rows, p)


def test_bounds_rule_centroids_out():
    rng = np.random.default_rng(5)
    centers = rng.standard_normal((30, 64)) * 80
    x = np.floor(centers[rng.integers(0, 30, 2000)] + rng.standard_normal((2000, 64)) * 10).astype(np.int64)
    axes = np.linalg.eigh(np.cov(x.T.astype(float)))[1][:, ::-1]
    measured = []

    class Counted(ct.Model):
        def measure(self, x, i, j):
            measured.append(len(i))
            return super().measure(x, i, j)

    m = ct.Model.of(np.floor(centers).astype(np.int64), axes, 16)
    turned = x @ axes
    own, distance = Counted(m.points, m.lead, m.rest).nearest(x, turned[:, :16], np.linalg.norm(turned[:, 16:], axis=1))
    every = ((x[:, None] - m.points[None]) ** 2).sum(2)
    assert (own == every.argmin(1)).all() and (distance == every.min(1)).all() and sum(measured) < 2.5 * len(x)
