import numpy as np
import pytest

from ledgerline.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, embedding array<float>, score long, rid string"


def brute(rows, params=hn.Params()):
    kept = []
    for i, label, v, *_ in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(np.float64(x)) for x in v):
            continue
        kept.append((i, (label + 1) % 10 if i % 7 == 0 else label, np.floor(256 * np.array(v, np.float32).astype(np.float64)).astype(np.int64)))
    out = []
    for a, (i, label, x) in enumerate(kept):
        if i % 50:
            continue
        scored = sorted(((-int(x @ y), j, lab == label) for b, (j, lab, y) in enumerate(kept) if b != a and len(y) == len(x)))
        for s, j, _ in [t for t in scored if t[2]][: params.positives]:
            near = [t for t in scored if not t[2] and 50 * -s <= 100 * -t[0] <= 95 * -s][: params.negatives]
            out += [(i, j, n, t[1], -s, -t[0]) for n, t in enumerate(near, 1)]
    return sorted(out)


def mined(spark, rows, **more):
    params = hn.Params(**more)
    coded = hn.prepare(spark.createDataFrame(rows, SCHEMA).repartition(3), params)
    return sorted(map(tuple, hn.mine(coded, coded.rows.filter("vec_id % 50 = 0"), params).collect()))


@pytest.mark.parametrize("width", [3, 64, 100])
def test_equals_brute_force(spark, width):
    rng = np.random.default_rng(width)
    v = rng.standard_normal((500, width)) / np.sqrt(width) + (np.arange(500) % 4 == 0)[:, None] * 0.2
    v[30:60] = v[0]
    v[60:70, :] = 0
    rows = [(int(i), int(rng.integers(0, 4)), [float(x) for x in v[i]], 1, "") for i in range(500)]
    rows += [(1000, None, [1.0] * width, 1, ""), (1050, 1, None, 1, ""), (1100, 1, [float("nan")] * width, 1, ""), (1150, 2, [None] * width, 1, ""), (None, 2, [0.5] * width, 1, ""), (1200, 2, [0.5, 0.25], 1, ""), (1201, 2, [0.5, 0.5], 1, ""), (1203, 3, [0.4, 0.3], 1, ""), (1250, 3, [], 1, "")]
    rows += [rows[50], rows[50], rows[3]]
    want = brute(rows)
    assert want and mined(spark, rows) == want
    assert mined(spark, rows, block_rows=40, block_anchors=3, bits=2) == want


def test_empty(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(50, 1, [1.0, 2.0], 0, "")]) == []


def test_intervals_hold_and_rule_out_rows():
    rng = np.random.default_rng(1)
    centers = rng.standard_normal((20, 64)) * 60
    x = np.floor(centers[rng.integers(0, 20, 3000)] + rng.standard_normal((3000, 64)) * 8).astype(np.int64)
    lower, upper = hn.Codes.of(x, hn.Centers(x[:200].tolist(), 64).of(64), 1).bounds(x[:40], 1, 6)
    exact = x[:40] @ x.T
    assert (lower <= exact).all() and (exact <= upper).all()
    fifth = np.sort(lower, axis=1)[:, -6]
    assert (upper >= fifth[:, None]).mean() < 0.2
