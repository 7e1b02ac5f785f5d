"""Findings and ordinals on small frames."""

import pytest
from pyspark.sql import functions as F

from ledgerline.functions.ordering import ranked
from ledgerline.functions.rules import RULES, described, distinct_findings, finding
from ledgerline.operators import identity, transactions

MARKERS = "case_id string, source_file string, start_position long, status string, gtid string"


def named(spark, *gtids):
    rows = [("A", "log.000001", 10 * n, "committed", g) for n, g in enumerate(gtids)]
    return transactions.named(spark.createDataFrame(rows, MARKERS))


def test_every_rule_once():
    assert len({r[0] for r in RULES}) == len(RULES)
    assert {r[1] for r in RULES} == {"info", "notice", "warning"}


def test_text_severity_and_repeats(spark):
    rows = spark.createDataFrame([("A", "TX-1", None), ("A", "TX-1", None), ("A", "TX-2", "7")], "case_id string, tx string, xid string")
    found = finding(rows, "R-GRP-002", F.col("tx"), transaction=F.col("tx"), xid=F.col("xid"))
    out = {(r.severity, r.text) for r in described(distinct_findings(found)).collect()}
    assert out == {("info", "TX-1 committed at XID "), ("info", "TX-2 committed at XID 7")}
    assert distinct_findings(found).count() == 2


def test_unfilled_text_stays_visible(spark):
    found = finding(spark.createDataFrame([("A",)], "case_id string"), "R-GRP-003", F.lit("x"))
    assert described(found).first().text == "{transaction} was rolled back"


def test_unknown_rule_is_an_error(spark):
    found = finding(spark.createDataFrame([("A",)], "case_id string"), "R-NONE-001", F.lit("x"))
    with pytest.raises(Exception, match="unknown rule R-NONE-001"):
        described(found).collect()


def test_ids_of_one_server_repeat(spark):
    rows = transactions.repeated_gtids(named(spark, "u1:5", "u1:5", "u1:6", "", None)).collect()
    assert [(r.tx_id, r.gtid, r.n) for r in rows] == [("TX-5", "u1:5", 2)]


def test_ids_of_several_servers_do_not(spark):
    own = named(spark, "aaaaaaaabb:5", "bbbbbbbbcc:5", "bbbbbbbbcc:5")
    assert transactions.repeated_gtids(own).isEmpty()
    assert {r.tx_id for r in own.collect()} == {"TX-aaaaaaaa-5", "TX-bbbbbbbb-5"}


def test_gtid_without_sequence_gives_a_place(spark):
    assert named(spark, "plain").first().tx_id == "TX-000001@0"


def test_separator_in_a_part_of_a_key(spark):
    rows = spark.createDataFrame([("A", "t", ["a|b"]), ("A", "t", ["a", "b"]), ("A", "t", None)], "case_id string, table string, key array<string>")
    assert [r.pk for r in identity.colliding(rows).collect()] == ["a|b"]


def test_one_table_name_in_two_databases(spark):
    rows = spark.createDataFrame([("A", "x", "t"), ("A", "y", "t"), ("A", "x", "u"), ("B", "x", "t")], "case_id string, database string, table string")
    assert [(r.case_id, r.table, r.names) for r in identity.shared_table_names(rows).collect()] == [("A", "t", ["x", "y"])]


def test_ordinals_are_gapless_in_each_case(spark):
    rows = spark.createDataFrame([(c, (n * 37) % 101) for c, size in (("A", 101), ("B", 7), ("C", 1)) for n in range(size)], "case_id string, k int")
    got = sorted((r.case_id, r.k, r.ordinal) for r in ranked(rows, [F.col("k")]).collect())
    want = []
    for c in "ABC":
        want += [(c, k, n) for n, k in enumerate(sorted(r.k for r in rows.collect() if r.case_id == c))]
    assert got == want
    assert ranked(rows.filter("k < 0"), [F.col("k")]).isEmpty()
