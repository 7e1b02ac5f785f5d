import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from ledgerline.llm import neighbours


def brute(ids, v, query_ids, k=5):
    v = v.astype(np.float64)
    norm = np.sqrt((v * v).sum(axis=1))
    out = {}
    for q in query_ids:
        i = int(np.flatnonzero(ids == q)[0])
        s = v @ v[i] / (norm * norm[i])
        order = np.lexsort((ids, -np.round(s, 12)))
        out[q] = [int(ids[j]) for j in order if j != i][:k]
    return out


def test_recall_where_lists_are_pruned(spark, tmp_path):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(1500, 32))
    v = centers[rng.integers(0, len(centers), 50_000)] + 0.35 * rng.normal(size=(50_000, 32))
    ids = np.arange(len(v))
    path = str(tmp_path / "vectors.parquet")
    pq.write_table(pa.table({"vec_id": ids, "embedding": list(v)}), path)
    df = spark.read.parquet(path)
    got = neighbours.search(df, df.filter("vec_id % 500 = 0")).toPandas()
    want = brute(ids, v, sorted(set(got.query_id)))
    assert len(want) == 100 and (got.groupby("query_id").size() == 5).all()
    hit = np.mean([len(set(want[q]) & set(g.vec_id)) / 5 for q, g in got.groupby("query_id")])
    p = neighbours.Params()
    index = neighbours.fit(neighbours.unit(v[rng.permutation(len(v))[: p.sample_rows]]), len(v) // p.list_size, p.degree)
    _, dist = index.nearest(neighbours.unit(v[::500]), p.beam)
    read = (dist[:, : p.probes] <= (1 + p.reach) * dist[:, :1]).sum(axis=1).mean() / len(index.points)
    print("recall", hit, "share of lists read", read)
    assert hit >= 0.9 and read < 0.1


def test_doubles_are_kept(spark):
    df = spark.createDataFrame([(0, [1.0, 1e-9]), (1, [0.6, 0.8]), (2, [1e39, 1e38]), (3, [1e-300, 1e-300])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.score for r in neighbours.search(df, df.filter("vec_id = 0")).collect()}
    assert set(got) == {1, 2, 3} and abs(got[1] - 0.6000000008) < 1e-13 and abs(got[2] - 10 / 101**0.5) < 1e-9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (3, [2.0, 0.0]), (4, [0.0, 1.0]), (5, None), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (10, [1.0]), (None, [1.0, 1.0]), (100, [0.0, 0.0]), (12, [1.0, 1.0])]
    rows += [(1000 + i, [1.0, 0.0]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("list", neighbours.F.lit(1))
    got = neighbours.search(df, df.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 6)))
    assert by[0] == [(3, 1.0), (50, 1.0), (1000, 1.0), (1001, 1.0), (1002, 1.0)]
    assert by[50] == [(0, 1.0), (3, 1.0), (1000, 1.0), (1001, 1.0), (1002, 1.0)]
    assert 100 not in by and len(by) == 2 + 6
    assert neighbours.search(df.limit(0), df.limit(0)).count() == 0
    one = df.filter("vec_id = 0")
    assert neighbours.search(one, one).count() == 0
