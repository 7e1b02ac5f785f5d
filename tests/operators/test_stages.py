"""Stages of an analysis are worked out when they are asked for, and take along only what they need."""

from pyspark.sql import functions as F

from ledgerline.functions.values import compare, compared, value
from ledgerline.plans.analysis import analyse
from ledgerline.review_queries import _transaction_accuracy
from test_situations import INSERT, case, img


def done(part) -> set[str]:
    return {k for k in vars(part) if not k.startswith("_")}


def one(spark):
    return analyse(case(spark, [INSERT, (200, 0, "UPDATE", img(1, "ann", "9.00"), img(1, None, "20.00"))], [(50, 250, "committed", [100, 200], "u:1")], [(img(1, "ann", "20.00"), False)], missing=("binlog.2",)))


def test_coverage_needs_no_other_stage(spark):
    a = one(spark)
    assert [r.complete for r in a.coverage.collect()] == [False]
    assert done(a) == {"gaps", "coverage"}


def test_events_are_ordered_without_claims(spark):
    a = one(spark)
    assert a.grouping.events.count() == 2
    assert done(a.grouping) == {"events"}
    assert not {"before", "after"} & set(a.grouping.placed.columns)


def test_runs_of_leading_events_need_no_records(spark):
    a = one(spark)
    assert a.grouping.transactions.filter("synthesised").count() == 0
    assert done(a) == {"grouping"} and "tx_events" not in done(a.grouping)


def test_records_need_no_transactions(spark):
    a = one(spark)
    assert [r.method for r in a.correlation.records.collect()] == ["pk_exact"]
    assert "record_events" not in done(a.correlation) and done(a.grouping) == {"placed"}


def test_history_needs_no_snapshot(spark):
    a = one(spark)
    assert [r.pk for r in a.history.contradicted.collect()] == ["1"]
    assert [r.partial for r in a.history.partial.collect()] == [["owner"]]
    assert not {"rows", "records"} & done(a.correlation) and "reconciliation" not in done(a)


def test_verdicts_of_records_without_written_fields(spark):
    a = one(spark)
    assert [(r.n_exact + r.n_strong, r.fields) for r in a.reconciliation.records.collect()] == [(4, 4)]
    assert not {"field_verdicts", "record_verdicts", "presence"} & done(a.reconciliation)


def test_marker_without_gtid_keeps_its_events(spark):
    a = analyse(case(spark, [INSERT], [(50, 250, "committed", [100], None)], []))
    assert [(r.n_events, r.rule_id) for r in a.grouping.transactions.collect()] == [(1, "R-GRP-002")]
    assert [r.durable for r in a.grouping.tx_events.collect()] == [True]


def test_values_alike_compare_as_before(spark):
    kinds = ("int", "dec", "str", "bool", "null", "ts", "ts_naive", "float", "undecodable")
    texts = ("1", "01.0", "x", "2026-08-15 19:06:25", None)
    rows = spark.createDataFrame([(k, t) for k in kinds for t in texts if k != "ts" or t is None or len(t) > 5], "k string, t string")
    df = rows.select(F.struct(F.col("k").alias("kind"), F.col("t").alias("text")).alias("a")).withColumn("b", F.col("a")).unionByName(rows.limit(1).select(F.lit(None).cast("struct<kind:string,text:string>").alias("a"), value("int", "1").alias("b")))
    got = compared(df, "a", "b").withColumn("w", compare(F.col("a"), F.col("b"))).filter("not (c <=> w)")
    assert got.collect() == []


def test_transactions_that_share_an_id_are_scored_one_by_one(spark):
    c = case(spark, [INSERT, (300, 0, "DELETE", img(1, "ann", "10.00"), None)], [(50, 150, "committed", [100], "u:1"), (250, 350, "rolled_back", [300], "u:1")], [])
    found = _transaction_accuracy(c, analyse(c)).first()
    assert (found.right_, found.wrong, found.missing, found.unexpected) == (2, 0, 0, 0)
