"""Small cases scored by hand: one situation each."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import transactions
from ledgerline.plans.analysis import analyse
from ledgerline.plans.change_log import Case

COLUMNS = (("account_id", "int", True), ("owner", "varchar(20)", False), ("balance", "decimal(10,2)", False))
VAL = "struct<kind:string,text:string>"
EVENT = f"case_id string, source_file string, log_position long, row_index int, ingest_ord long, event_type string, database string, table string, before map<string,{VAL}>, after map<string,{VAL}>, ts timestamp, thread_id long"


def img(key=None, owner=None, balance=None):
    out = {}
    if key is not None:
        out["account_id"] = ("int", str(key))
    if owner is not None:
        out["owner"] = ("str", owner)
    if balance is not None:
        out["balance"] = balance if isinstance(balance, tuple) else ("dec", balance)
    return out


def case(spark, events, markers, snapshot, missing=(), health="valid", columns=COLUMNS, name="A"):
    at = dt.datetime(2026, 8, 15, 19, 6, 25)
    ev = [(name, "binlog.1", p, r, n, k, "fin", "accounts", b, a, at, 13) for n, (p, r, k, b, a) in enumerate(events)]
    mk = [(name, "binlog.1", s, e, st, ps, g, None, 13) for s, e, st, ps, g in markers]
    sn = [(name, n, "fin", "accounts", v, d) for n, (v, d) in enumerate(snapshot)]
    files = [(name, 1, "/log/binlog.1", True)] + [(name, 2 + n, f"/log/{m}", False) for n, m in enumerate(missing)]
    table = spark.createDataFrame([(name, "fin", "accounts")], "case_id string, database string, table string")
    return Case(
        spark.createDataFrame(ev, EVENT), spark.createDataFrame(mk, "case_id string, source_file string, start_position long, end_position long, status string, event_positions array<long>, gtid string, xid long, thread_id long"),
        spark.createDataFrame([(name, "fin", "accounts", c, n, t, pk) for n, (c, t, pk) in enumerate(columns, 1)], "case_id string, database string, table string, column string, position int, data_type string, is_primary_key boolean"),
        spark.createDataFrame(sn, f"case_id string, snapshot_ord long, database string, table string, values map<string,{VAL}>, is_deleted boolean"),
        spark.createDataFrame(files, "case_id string, seq int, file string, present boolean"), table.withColumns({"status": F.lit(health), "total_pages": F.lit(7), "damaged_pages": F.lit(0)}), table, table,
    )


def verdicts(a):
    return {(r.pk, r.column): (r.result, r.rule_id) for r in a.field_verdicts.collect()}


INSERT = (100, 0, "INSERT", None, img(1, "ann", "10.00"))
COMMIT = (50, 250, "committed", [100], "u:1")


def test_deleted_row_agrees(spark):
    a = analyse(case(spark, [INSERT, (200, 0, "DELETE", img(1, "ann", "10.00"), None)], [(50, 250, "committed", [100, 200], "u:1")], [(img(1, "ann", "10.00"), True)]))
    assert verdicts(a)["1", "presence"] == ("Exact", "R-RECON-023")


def test_rolled_back_value_in_snapshot(spark):
    a = analyse(case(spark, [INSERT, (200, 0, "UPDATE", img(1, "ann", "10.00"), img(1, "ann", "99.00"))], [COMMIT, (190, 260, "rolled_back", [200], "u:2")], [(img(1, "ann", "99.0"), False)]))
    assert verdicts(a)["1", "balance"] == ("Conflicting", "R-RECON-003")
    assert [r.rule_id for r in a.explanations.collect()] == ["R-RECON-030"]
    assert a.record_verdicts.first().label == "balance: Conflicting"


def test_open_transaction_and_truncated_log(spark):
    a = analyse(case(spark, [INSERT], [COMMIT, (300, 400, "incomplete", [], "u:2")], [(img(1, "ann", "10"), False)]))
    assert verdicts(a)["1", "balance"] == ("Strong", "R-RECON-002")
    assert [(r.rule_id, r.after_file) for r in a.gaps.collect()] == [("R-COV-003", "binlog.1")]


def test_key_change_is_one_record(spark):
    a = analyse(case(spark, [INSERT, (200, 0, "UPDATE", img(1, "ann", "10.00"), img(11, "ann", "10.00"))], [(50, 250, "committed", [100, 200], "u:1")], [(img(11, "ann", "10.00"), False)]))
    record = a.correlation.records.collect()
    assert [(r.pk, r.method, r.previous) for r in record] == [("11", "pk_update_continuity", ["1"])]
    assert {v for v, _ in verdicts(a).values()} == {"Exact"}


def test_missing_later_file(spark):
    a = analyse(case(spark, [INSERT], [COMMIT], [(img(1, "ann", "12.00"), False)], missing=("binlog.2",)))
    assert verdicts(a)["1", "balance"] == ("Unresolved", "R-RECON-004")
    assert not a.coverage.first().complete


def test_undecodable_and_unvalidated_types(spark):
    columns = (*COLUMNS, ("spot", "point", False))
    a = analyse(case(spark, [(100, 0, "INSERT", None, img(1, "ann", "10.00") | {"spot": ("str", "x")})], [COMMIT], [(img(1, None, "10.00") | {"owner": ("undecodable", "bad"), "spot": ("str", "x")}, False)], columns=columns))
    v = verdicts(a)
    assert v["1", "owner"] == ("Unsupported", "R-RECON-007") and v["1", "spot"] == ("Unsupported", "R-RECON-008") and v["1", "balance"] == ("Exact", "R-RECON-001")
    assert a.record_verdicts.first().result == "Partial"


def test_damaged_table(spark):
    v = verdicts(analyse(case(spark, [INSERT], [COMMIT], [(img(1, "ann", "10.00"), False)], health="damaged")))
    assert v["1", "balance"] == ("Unresolved", "R-RECON-009") and v["1", "presence"] == ("Unresolved", "R-RECON-009")


def test_no_primary_key(spark):
    a = analyse(case(spark, [INSERT], [COMMIT], [(img(1, "ann", "10.00"), False)], columns=[(c, t, False) for c, t, _ in COLUMNS]))
    assert verdicts(a) == {("", "table"): ("Unsupported", "R-CORR-020")}


def test_partial_image(spark):
    a = analyse(case(spark, [INSERT, (200, 0, "UPDATE", img(1, "ann", "10.00"), img(1, None, "20.00"))], [(50, 250, "committed", [100, 200], "u:1")], [(img(1, "bob", "20.00"), False)]))
    assert verdicts(a)["1", "owner"] == ("Unresolved", "R-RECON-004") and verdicts(a)["1", "balance"] == ("Exact", "R-RECON-001")


@pytest.mark.parametrize("thread", [13, None])
def test_overlapping_session_markers(spark, thread):
    c = case(spark, [(100, 0, "INSERT", None, img(1)), (150, 0, "INSERT", None, img(2)), (200, 0, "INSERT", None, img(3))], [(90, 160, "committed", [], "u:1"), (140, 210, "committed", [], "u:2")], [])
    events = c.events.withColumn("thread_id", F.when(F.col("log_position") != 200, 13).otherwise(F.lit(thread)))
    claims, refused = transactions.claim_by_session(events, c.markers, transactions.claim_by_position(events, c.markers))
    got = sorted((r.start_position, r.log_position) for r in claims.collect())
    assert got == ([(90, 100), (90, 150), (140, 200)] if thread else [(90, 100), (90, 150)])
    assert refused.count() == (0 if thread else 1)


def test_order_of_rows_does_not_matter(spark):
    from ledgerline.plans.change_log import derive

    c = derive(spark, "/root/testdata/sf0.001")
    limit = c.events.filter("log_position < 6000")
    one = transactions.group(limit, c.markers, c.log_files).tx_events.drop("ord", "ts")
    two = transactions.group(limit.repartition(7), c.markers.repartition(5), c.log_files).tx_events.drop("ord", "ts")
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()
