import zlib

import xxhash

from ledgerline.llm import sharding


def spark_hash(*values):
    """xxhash64 of Spark as a signed number: each value's hash seeds that of the next; nulls are passed over."""
    seed = 42
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else v.to_bytes(4 if isinstance(v, Int) else 8, "little", signed=True)
            seed = xxhash.xxh64_intdigest(data, seed)
    return seed - (1 << 64) if seed >> 63 else seed


class Int(int):
    """A number of 32 bits."""


def brute_force(files, n_shards, seed, n_buckets):
    """Shards as lists of records, from {file name: rows in order}: scatter, Fisher-Yates, deal."""
    buckets = [[] for _ in range(n_buckets)]
    for name, rows in files.items():
        for at, row in enumerate(rows):
            content = spark_hash(*row)
            place = spark_hash(Int(seed), name, at, content)
            buckets[spark_hash(Int(seed), place) % n_buckets].append((place, content, row))
    line = []
    for b, held in enumerate(buckets):
        held.sort(key=lambda r: r[:2])
        for i in range(len(held) - 1, 0, -1):
            j = spark_hash(Int(seed), b, Int(i)) % (i + 1)
            held[i], held[j] = held[j], held[i]
        line += [row for _, _, row in held]
    return [line[s::n_shards] for s in range(n_shards)]


def test_equals_the_permutation_in_plain_python_whatever_the_splits(spark, tmp_path, monkeypatch):
    rows = [(i % 170, f"text {i % 170} " * (i % 9)) for i in range(400)] + [(None, None), (None, ""), (3, "x" * 50_000)] * 5
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    files = {}
    for f in sorted((tmp_path / "docs").glob("part-*.parquet")):
        files[f.name] = [(r.doc_id, r.text) for r in spark.read.parquet(str(f)).coalesce(1).collect()]
    monkeypatch.setattr(sharding, "SPAN", 4)
    names = {"spark.sql.files.maxPartitionBytes": "500", "spark.sql.files.openCostInBytes": "0"}
    want = brute_force(files, 7, 5, -(-len(rows) // 40))
    for other in (False, True):
        try:
            for name, value in names.items() if other else ():
                spark.conf.set(name, value)
            docs = spark.read.parquet(path)
            got = sorted((r.shard, r.slot, r.doc_id, r.text) for r in sharding.shard(docs, 7, seed=5, bucket_rows=40).collect())
        finally:
            for name in names:
                spark.conf.unset(name)
        assert [(a, b, c, d) for a, b, c, d in got] == [(a, b, *row) for a, shard in enumerate(want) for b, row in enumerate(shard)]


def test_every_order_of_three_comes_up_alike(spark):
    made = spark.range(12_000).select(sharding.fisher_yates(sharding.F.array(*map(sharding.F.lit, "abc")), sharding.F.col("id"), 1).alias("o"))
    counts = [r["count"] for r in made.groupBy("o").count().collect()]
    assert len(counts) == 6 and all(1800 < n < 2200 for n in counts)


def test_clashing_columns(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.range(50).selectExpr("id as doc_id", "'t' as text", "id as rec", "id as bucket", "id as place", "id as slot", "map('a', id) as m").write.parquet(path)
    clash = spark.read.parquet(path)
    for docs in (clash, clash.withColumn("_metadata", sharding.F.lit("own"))):
        out = sharding.shard(docs, 4, bucket_rows=8)
        assert out.count() == 50 and set(out.columns) == {*docs.columns, "shard"}
        assert out.filter("rec = doc_id and bucket = doc_id and place = doc_id and m['a'] = doc_id").count() == 50


def test_counts_slots_and_digest(spark):
    rows = [(i, f"text {i}" * (i % 7), i) for i in range(203)] + [(None, None, 0), (5, "same", 1), (5, "same", 1), (9, "x" * 200_000, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(5)
    out = sharding.digest(sharding.shard(docs, 16, bucket_bytes=4096)).toPandas()
    assert len(out) == len(rows)
    counts = out.groupby("shard").size()
    assert counts.max() - counts.min() <= 1 and set(out["shard"]) == set(range(16))
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    want = sorted((i if i is not None else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert sorted(zip(out.doc_id.fillna(-1).astype(int), out["size"], out.text_crc32, strict=True)) == want


def test_order_is_mixed_and_written(spark, tmp_path):
    docs = spark.range(2000).selectExpr("id as doc_id", "cast(id as string) as text")
    out = sharding.shard(docs, 2)
    first = [r.doc_id for r in out.filter("shard = 0").orderBy("slot").limit(200).collect()]
    assert first != sorted(first) and max(first) > 1000
    path = sharding.write_shards(out, f"file://{tmp_path}/shards")
    assert spark.read.parquet(path).count() == 2000


def test_empty(spark):
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_other_numbers_of_shuffle_partitions_give_the_same_result(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    seen = []
    for n in ("4", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(sorted(map(tuple, sharding.shard(docs, 16, bucket_bytes=30_000).select("doc_id", "shard", "slot").collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1] and len(seen[0]) > 100


def test_computed_input_and_hot_rows(spark):
    docs = spark.range(3000).selectExpr("id % 3 as doc_id", "'same' as text").groupBy("doc_id", "text").count().selectExpr("doc_id", "text", "explode(sequence(1, 900)) as slot")
    out = sharding.digest(sharding.shard(docs, 8, bucket_bytes=2000)).toPandas()
    assert len(out) == 2700 and out.groupby("shard").size().max() - out.groupby("shard").size().min() <= 1
