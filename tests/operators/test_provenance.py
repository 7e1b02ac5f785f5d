from dataclasses import replace

from pyspark.sql import functions as F

from ledgerline.operators import provenance
from ledgerline.plans import stale
from ledgerline.plans.analysis import analyse
from test_situations import COMMIT, INSERT, case, img

RUNS = "case_id string, run_id string, source_file string, from_position long, started long, status string"


def test_own_recorded_or_none(spark):
    events = spark.createDataFrame([("A", "/x/log.1", 100, 0, "mine"), ("A", "/x/log.1", 100, 1, None), ("A", "log.1", 900, 0, None), ("A", "log.2", 5, 0, None), ("B", "log.1", 100, 0, None)], "case_id string, source_file string, log_position long, row_index int, run_id string")
    runs = spark.createDataFrame([("A", "r1", "log.1", 0, 1, "ok"), ("A", "r3", "log.1", 500, 3, "ok"), ("A", "r2", "/y/log.1", 0, 2, "ok"), ("A", "r9", "log.2", 0, 1, "failed"), ("B", "r5", "log.1", 101, 1, "ok")], RUNS)
    got = {(r.case_id, r.source_file, r.log_position, r.row_index): (r.run_id, r.run_basis) for r in provenance.event_runs(events, runs).collect()}
    assert got == {("A", "/x/log.1", 100, 0): ("mine", "own"), ("A", "/x/log.1", 100, 1): ("r2", "recorded"), ("A", "log.1", 900, 0): ("r3", "recorded"), ("A", "log.2", 5, 0): (None, None), ("B", "log.1", 100, 0): (None, None)}
    assert sorted((r.case_id, r.subject) for r in provenance.missing_runs(events, runs).collect()) == [("A", "log.2"), ("B", "log.1")]


def test_the_analysis_says_which_file_no_run_decoded(spark):
    c = case(spark, [INSERT], [COMMIT], [(img(1, "ann", "10.00"), False)])
    found = lambda runs: [r.subject for r in analyse(replace(c, runs=spark.createDataFrame(runs, RUNS))).findings.filter("rule_id = 'R-PROV-001'").collect()]
    assert found([]) == ["binlog.1"] and found([("A", "r1", "binlog.1", 0, 1, "ok")]) == []


def test_fingerprints_tell_values_apart_and_not_order(spark):
    schema = "case_id string, a string, m map<string,string>"
    rows = [("A", "x", {"k": "1", "l": "2"}), ("A", None, None), ("A", "x", {"k": "1", "l": "2"})]
    prints = lambda rows: [tuple(r) for r in stale.fingerprint(spark.createDataFrame(rows, schema)).collect()]
    same = prints([("A", None, None), ("A", "x", {"l": "2", "k": "1"}), ("A", "x", {"l": "2", "k": "1"})])
    assert prints(rows) == same
    for other in ([*rows, rows[0]], [("A", "", None), *rows[:1], rows[2]], [("A", "x", {"k": "2", "l": "1"}), *rows[1:]], [("A", "x", {}), *rows[1:]]):
        assert prints(other) != same


def test_a_changed_snapshot_makes_exactly_the_later_stages_stale(spark):
    c = case(spark, [INSERT], [COMMIT], [(img(1, "ann", "10.00"), False)])
    other = replace(c, snapshot=c.snapshot.withColumn("is_deleted", F.lit(True)))
    told = lambda then, now: {r.stage: r.changed for r in stale.stale(stale.inputs(then), stale.inputs(now)).collect()}
    assert told(c, other) == {"correlation": "snapshot", "reconstruction": "snapshot", "reconciliation": "snapshot"}
    assert told(c, replace(c, events=c.events.repartition(3))) == {}
    assert told(c, replace(c, health=c.health.limit(0))) == {"reconciliation": "health"}
    assert set(told(c, replace(c, log_files=c.log_files.withColumn("present", F.lit(False))))) == set(stale.STAGES)
