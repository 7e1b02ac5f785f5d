from ledgerline.streaming import logs

SF = "/root/testdata/sf0.001/events.parquet"


def test_repeats_are_removed(spark, tmp_path):
    events = spark.read.parquet(SF)
    events.union(events.limit(50)).repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = logs.without_repeats(logs.read_events(spark, f"file://{tmp_path}/in", events.schema, 10), ["event_id"], delay="1000 days")
    q = stream.writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/c").start()
    q.awaitTermination(120)
    assert spark.table("once").count() == events.count()


def test_latest_state(spark, tmp_path):
    cells = spark.read.parquet(SF).selectExpr("cast(user_id as string) as key", "event_type as value", "event_id as ord")
    cells.repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = logs.read_events(spark, f"file://{tmp_path}/in", cells.schema, 1)
    logs.keep_latest(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/c", ["key"], 4).awaitTermination(200)
    got = logs.current(spark.read.parquet(f"file://{tmp_path}/out")).select("key", "value", "ord")
    want = logs.latest(cells, ["key"]).select("key", "value", "ord")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_open_transactions(spark, tmp_path):
    rows = [("t1", "INSERT", 1), ("t1", "UPDATE", 2), ("t1", "COMMIT", 3), ("t2", "INSERT", 2), ("t3", "INSERT", 3), ("t3", "ROLLBACK", 4)]
    df = spark.createDataFrame(rows, "tx string, event_type string, n int").selectExpr("tx", "event_type", "timestamp '2026-01-01' + make_dt_interval(0, 0, n) as ts")
    df.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    spark.createDataFrame([("t9", "COMMIT", 5)], "tx string, event_type string, n int").selectExpr("tx", "event_type", "timestamp '2026-02-01' as ts").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    out = logs.transactions(logs.read_events(spark, f"file://{tmp_path}/in", df.schema, 1), ["tx"], delay="1 minute", open_for_ms=60_000)
    q = out.writeStream.format("memory").queryName("txs").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/c").start()
    q.awaitTermination(200)
    got = {r.tx: (r.n_events, r.status) for r in spark.table("txs").collect()}
    assert got["t1"] == (2, "committed") and got["t3"] == (1, "rolled_back") and got.get("t2", (1, "incomplete")) == (1, "incomplete")


def _members(spark, tmp_path, schema):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    logs.use_state_store(spark)
    out = logs.open_transactions(logs.read_events(spark, f"file://{tmp_path}/in", schema, 1), ["tx"], ["position", "event_type"], delay="1 minute", open_for_ms=60_000)
    q = out.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/c").start()
    q.awaitTermination(300)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert q.exception() is None
    rows = spark.read.parquet(f"file://{tmp_path}/out").collect()
    return {(r.tx, r.position, r.event_type, r.status) for r in rows}, len(rows)


def test_open_transactions_keep_their_rows_over_restarts_and_time_out(spark, tmp_path):
    def arrive(*rows):
        frame = spark.createDataFrame(list(rows), "tx string, event_type string, position long, n int")
        frame.selectExpr("tx", "event_type", "position", "timestamp '2026-01-01' + make_dt_interval(0, 0, 0, n) as ts").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        return frame.selectExpr("tx", "event_type", "position", "timestamp '2026-01-01' as ts").schema

    schema = arrive(("t1", "INSERT", 10, 1), ("t1", "UPDATE", 20, 2), ("t2", "INSERT", 15, 2), ("t3", "COMMIT", 31, 3), ("t3", "DELETE", 30, 3))
    got, n = _members(spark, tmp_path, schema)
    assert got == {("t3", 30, "DELETE", "committed")} and n == 1
    # another run of the query goes on from the state that the first one left
    arrive(("t1", "INSERT", 25, 4), ("t1", "ROLLBACK", 26, 5), ("t4", "COMMIT", 40, 5))
    got, n = _members(spark, tmp_path, schema)
    assert got - {("t3", 30, "DELETE", "committed")} == {("t1", 10, "INSERT", "rolled_back"), ("t1", 20, "UPDATE", "rolled_back"), ("t1", 25, "INSERT", "rolled_back"), ("t4", None, None, "committed")} and n == 5
    arrive(("t9", "COMMIT", 99, 3000), ("t9", "INSERT", 98, 3000))
    arrive(("t8", "COMMIT", 97, 3100), ("t8", "INSERT", 96, 3100))
    got, n = _members(spark, tmp_path, schema)
    assert ("t2", 15, "INSERT", "incomplete") in got and n == 8


def test_stored_state_stays_bounded_over_many_batches(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    for n in range(60):
        spark.range(40).selectExpr("cast(id as string) as key", f"'v{n}' as value", f"{n} * 100 + id as ord").filter(f"id % 3 = {n} % 3 or id < 5").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    schema = spark.read.parquet(f"file://{tmp_path}/in").schema
    out = f"file://{tmp_path}/out"
    logs.keep_latest(logs.read_events(spark, f"file://{tmp_path}/in", schema, 1), out, f"file://{tmp_path}/c", ["key"], 2).awaitTermination(900)
    files = list((tmp_path / "out").rglob("*.parquet"))
    assert len({f.parent for f in files}) <= 4 and len(files) <= 8
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = logs.current(spark.read.parquet(out)).select("key", "value", "ord")
    want = logs.latest(spark.read.parquet(f"file://{tmp_path}/in"), ["key"]).select("key", "value", "ord")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
