"""Queries over what a reviewer is shown: groups of flagged records, report groups, export selections, provenance."""

from __future__ import annotations

import uuid
from dataclasses import fields, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import rules, values
from .operators import export, groups, history, identity, provenance, quality, redaction, reports, serving, summary, transactions
from .oracle import CATALOGUE, FOUND, STEPS, chain
from .plans import stale
from .plans.analysis import Analysis, analyse
from .plans.change_log import Case, base, derive
from .queries import FILE, analysis_of, query, read, rec
from .queries import _catalogs as catalogs
from .sources import render, text
from .sources.tables import shared_dir

# --- V06: flagged records that share transactions ---------------------------------------------------------------------

GROUPED = (
    "WITH RECURSIVE "
    + chain("").removeprefix("WITH ")
    + """,
th AS MATERIALIZED (SELECT DISTINCT case_id, key, tx FROM rev WHERE tx IS NOT NULL),
bad AS MATERIALIZED (SELECT DISTINCT case_id, key FROM vr WHERE res IN ('Conflicting', 'Unresolved')),
fl AS MATERIALIZED (SELECT t.* FROM th t JOIN bad USING (case_id, key)),
st AS MATERIALIZED (SELECT case_id, key, min(CAST(key AS VARCHAR)) OVER (PARTITION BY case_id, tx) AS hub FROM fl),
lk AS MATERIALIZED (SELECT case_id, CAST(key AS VARCHAR) AS a, hub AS b FROM st UNION SELECT case_id, hub, CAST(key AS VARCHAR) FROM st),
cc(case_id, node, root) USING KEY (case_id, node) AS (
  SELECT DISTINCT case_id, a, a FROM lk
  UNION SELECT l.case_id, l.a, min(c.root) FROM cc c JOIN lk l ON l.case_id = c.case_id AND l.b = c.node JOIN recurring.cc o ON o.case_id = l.case_id AND o.node = l.a WHERE c.root < o.root GROUP BY l.case_id, l.a),
ing AS MATERIALIZED (SELECT DISTINCT f.case_id, f.key, c.root FROM fl f JOIN cc c ON c.case_id = f.case_id AND c.node = CAST(f.key AS VARCHAR)),
gt AS MATERIALIZED (SELECT DISTINCT i.case_id, i.root, t.tx FROM ing i JOIN th t ON t.case_id = i.case_id AND t.key = i.key),
gr AS MATERIALIZED (SELECT DISTINCT g.case_id, g.root, t.key, i.key IS NOT NULL AS flagged FROM gt g JOIN th t ON t.case_id = g.case_id AND t.tx = g.tx LEFT JOIN ing i ON i.case_id = t.case_id AND i.key = t.key AND i.root = g.root)
"""
)
KIND = "CASE WHEN bool_or(res = 'Conflicting') THEN 'conflicting' WHEN bool_or(res = 'Unresolved') THEN 'unresolved' WHEN bool_or(res = 'Unsupported') THEN 'unsupported' ELSE 'agreeing' END"


def _groups(a: Analysis) -> groups.Groups:
    return groups.flagged_groups(a.correlation.record_events, a.record_verdicts.filter("flagged"), a.field_verdicts)


query("v06_group_transactions", GROUPED + "SELECT case_id, 'shop.orders:' || root AS group_id, tx AS tx_id FROM gt")(lambda a: _groups(a).transactions)
query("v06_group_records", GROUPED + "SELECT g.case_id, 'shop.orders:' || g.root AS group_id, CAST(g.key AS VARCHAR) AS pk, g.flagged, k.kind FROM gr g JOIN (SELECT case_id, key, " + KIND + " AS kind FROM vr GROUP BY ALL) k ON k.case_id = g.case_id AND k.key = g.key")(
    lambda a: _groups(a).records.select("case_id", "group_id", "pk", "flagged", "kind")
)
query("v06_group_edges", GROUPED + "SELECT DISTINCT g.case_id, 'shop.orders:' || g.root AS group_id, g.tx AS tx_id, CAST(t.key AS VARCHAR) AS pk FROM gt g JOIN th t ON t.case_id = g.case_id AND t.tx = g.tx")(
    lambda a: _groups(a).edges.select("case_id", "group_id", "tx_id", "pk")
)
query(
    "v06_group_names",
    GROUPED + "SELECT r.case_id, 'shop.orders:' || r.root AS group_id, string_agg('orders:' || CAST(r.key AS VARCHAR), '+' ORDER BY r.key) FILTER (WHERE r.flagged) AS id, count(*) FILTER (WHERE r.flagged) AS flagged, count(*) FILTER (WHERE NOT r.flagged) AS neighbours, any_value(t.n) AS transactions FROM gr r JOIN (SELECT case_id, root, count(*) AS n FROM gt GROUP BY ALL) t ON t.case_id = r.case_id AND t.root = r.root GROUP BY r.case_id, r.root",
)(lambda a: _groups(a).names)

# --- R12, G05 to G08: where values come from, and report groups --------------------------------------------------------

PROVENANCE = """,
prov AS (SELECT case_id, key, col, CASE WHEN whole THEN f1 ELSE f2 END AS pf, CASE WHEN whole THEN p1 ELSE p2 END AS pp, CASE WHEN whole THEN r1 ELSE r2 END AS pr FROM (
  SELECT case_id, key, arg_max(f, ord) FILTER (WHERE dur AND ty <> 'DELETE') AS f1, arg_max(pos, ord) FILTER (WHERE dur AND ty <> 'DELETE') AS p1, arg_max(ri, ord) FILTER (WHERE dur AND ty <> 'DELETE') AS r1,
    arg_max(f, ord) FILTER (WHERE dur AND ty <> 'DELETE' AND part = 0) AS f2, arg_max(pos, ord) FILTER (WHERE dur AND ty <> 'DELETE' AND part = 0) AS p2, arg_max(ri, ord) FILTER (WHERE dur AND ty <> 'DELETE' AND part = 0) AS r2 FROM rev GROUP BY case_id, key)
  CROSS JOIN (VALUES ('o_orderkey', true), ('o_custkey', false), ('o_orderstatus', false), ('price_cents', true), ('o_orderpriority', false)) c(col, whole))
"""
query("r12_value_set_by", chain(PROVENANCE + "SELECT case_id, CAST(key AS VARCHAR) AS pk, col AS field, " + FILE.format("pf") + " AS source_file, pp AS log_position, CAST(pr AS BIGINT) AS row_index FROM prov WHERE pf IS NOT NULL"))(
    lambda a: rec(a.history.states.filter("set_by is not null"), F.col("column").alias("field"), "set_by.source_file", "set_by.log_position", F.col("set_by.row_index").cast("long").alias("row_index"))
)

_PLACED = "('R-GRP-009', 'R-GRP-010', 'R-GRP-011', 'R-GRP-013')"
_OF_TX = "('R-GRP-001', 'R-GRP-002', 'R-GRP-003', 'R-GRP-004', 'R-GRP-006', 'R-GRP-014')"
OBSERVED = (
    PROVENANCE
    + f""",
why AS (SELECT f.case_id, f.key, f.col, CASE WHEN (f.col = 'price_cents' AND f.psp = f.price) OR (f.col = 'o_orderkey' AND s.ksp = f.key) THEN 'R-RECON-030' WHEN s.n > 0 AND NOT EXISTS (SELECT 1 FROM rev r WHERE r.case_id = f.case_id AND r.key = f.key AND r.ty <> 'DELETE' AND CASE f.col WHEN 'price_cents' THEN r.ap = f.price WHEN 'o_orderkey' THEN r.ak = f.key END) THEN 'R-RECON-031' ELSE '' END AS ctx
  FROM fld f LEFT JOIN (SELECT case_id, key, arg_max(ak, ord) FILTER (WHERE ty <> 'DELETE') AS ksp, count(*) FILTER (WHERE ty <> 'DELETE') AS n FROM rev GROUP BY ALL) s ON s.case_id = f.case_id AND s.key = f.key WHERE f.rule = 'R-RECON-003'),
sides AS (SELECT case_id, key, col, concat_ws(' + ', CASE WHEN has_log THEN 'log' END, CASE WHEN has_phys THEN 'snapshot' END) AS side FROM fld UNION ALL SELECT case_id, key, 'presence', 'log + snapshot' FROM pre),
fo AS (SELECT v.case_id, 'record' AS kind, 'shop.orders' AS "table", v.col AS field, v.res AS result, v.rule AS rule_id, 'warning' AS severity, CASE WHEN s.side = '' THEN 'Unknown' ELSE s.side END AS evidence, CAST(v.key AS VARCHAR) || '|' || v.col AS identity, CAST(v.key AS VARCHAR) AS record, coalesce(w.ctx, '') AS context,
  coalesce({FILE.format("p.pf")}, 'Unknown') AS source_file, p.pp AS log_position, p.pr AS row_index
  FROM vr v JOIN sides s ON s.case_id = v.case_id AND s.key = v.key AND s.col = v.col LEFT JOIN why w ON w.case_id = v.case_id AND w.key = v.key AND w.col = v.col LEFT JOIN prov p ON p.case_id = v.case_id AND p.key = v.key AND p.col = v.col AND p.pf IS NOT NULL WHERE v.res <> 'Exact'),
fd AS (SELECT DISTINCT case_id, rule_id, subject, text FROM ({FOUND})),
fn AS (SELECT d.*, c.severity, CASE WHEN rule_id IN {_PLACED} THEN split_part(subject, ':', 1) WHEN rule_id = 'R-HIST-008' THEN regexp_extract(text, '(log[.][0-9]+):[0-9]+', 1) WHEN rule_id IN {_OF_TX} THEN m.file WHEN rule_id = 'R-GRP-005' THEN 'log.' || regexp_extract(subject, 'TX-SYNTH-([0-9]+)', 1) WHEN rule_id = 'R-COV-002' THEN subject WHEN rule_id = 'R-HIST-009' THEN 'log.000006' END AS file,
  CASE WHEN rule_id IN {_PLACED} THEN CAST(regexp_extract(subject, ':([0-9]+)#', 1) AS BIGINT) WHEN rule_id = 'R-HIST-008' THEN CAST(regexp_extract(text, 'log[.][0-9]+:([0-9]+)', 1) AS BIGINT) END AS lp, CASE WHEN rule_id IN {_PLACED} THEN CAST(regexp_extract(subject, '#([0-9]+)', 1) AS BIGINT) END AS lr
  FROM fd d JOIN {CATALOGUE} ON c.id = d.rule_id LEFT JOIN mkn m ON m.case_id = d.case_id AND m.tx = d.subject WHERE c.severity <> 'info' OR rule_id LIKE 'R-COV-%'),
ob AS (SELECT * FROM fo UNION ALL SELECT case_id, 'warning', CASE WHEN rule_id LIKE 'R-HIST-%' OR rule_id IN ('R-CORR-010', 'R-CORR-012', 'R-CORR-022', 'R-CORR-023', 'R-CORR-031') THEN 'orders' ELSE 'Case / unknown table' END, '', '', rule_id, severity, CASE WHEN file IS NULL THEN 'Unknown' ELSE 'log' END, subject || '|' || text,
  CASE WHEN rule_id LIKE 'R-HIST-%' OR rule_id IN ('R-CORR-010', 'R-CORR-012', 'R-CORR-022', 'R-CORR-023', 'R-CORR-031') THEN subject END, subject || '|' || text, coalesce(file, 'Unknown'), lp, lr FROM fn)
"""
)


def _observed(a: Analysis):
    return summary.observations(a.field_verdicts, a.history.states, a.explanations, a.findings)


KEYS = 'case_id, kind, "table", field, result, rule_id, severity, evidence'
query("g05_report_groups", chain(OBSERVED + f"SELECT {KEYS}, count(DISTINCT identity) AS occurrences, count(DISTINCT record) AS records, count(DISTINCT context) AS contexts, count(DISTINCT source_file) AS sources FROM ob GROUP BY ALL"))(lambda a: summary.exception_groups(_observed(a)))
query(
    "g06_group_sources",
    chain(OBSERVED + f"SELECT {KEYS}, source_file, count(DISTINCT (log_position, coalesce(row_index, -1))) FILTER (WHERE log_position IS NOT NULL) AS located, min(log_position) AS first_position, max(log_position) AS last_position, count(DISTINCT identity) FILTER (WHERE log_position IS NULL) AS \"unknown\" FROM ob GROUP BY ALL"),
)(lambda a: summary.source_ranges(_observed(a)))
query(
    "g07_totals_by_table",
    chain("""SELECT c.case_id, t."table", g.granularity, r.result, count(v.key) AS n FROM (SELECT DISTINCT case_id FROM rec) c CROSS JOIN (VALUES ('shop.orders'), (NULL)) t("table") CROSS JOIN (VALUES ('records'), ('fields')) g(granularity) CROSS JOIN (VALUES ('Exact'), ('Strong'), ('Partial'), ('Unsupported'), ('Unresolved'), ('Conflicting')) r(result)
LEFT JOIN (SELECT case_id, key, res, 'fields' AS granularity FROM vr UNION ALL SELECT case_id, key, res, 'records' FROM rolled) v ON v.case_id = c.case_id AND v.res = r.result AND v.granularity = g.granularity GROUP BY ALL"""),
)(lambda a: summary.totals(a.reconciliation.records))
query(
    "g08_input_counts_by_table",
    chain("SELECT case_id, 'snapshot' AS section, 'shop.orders' AS \"table\", CASE WHEN del THEN 'deleted' ELSE 'live' END AS category, count(*) AS n FROM sn GROUP BY ALL UNION ALL SELECT case_id, 'events', 'shop.orders', ty, count(*) FROM ev1 GROUP BY ALL UNION ALL SELECT c.case_id, 'schemas', 'shop.orders', 'columns', 5 FROM (VALUES ('A'), ('B')) c(case_id)"),
    "case",
)(lambda c: summary.input_counts(c.snapshot, c.events, c.catalog))

# --- G16: what an export holds ----------------------------------------------------------------------------------------

SELECTED = """,
sel AS MATERIALIZED (SELECT DISTINCT case_id, key FROM vr WHERE res <> 'Exact'),
str AS MATERIALIZED (SELECT t.case_id, t.tx, CASE WHEN EXISTS (SELECT 1 FROM rev r JOIN sel s ON s.case_id = r.case_id AND s.key = r.key WHERE r.case_id = t.case_id AND r.tx = t.tx) THEN 'touches_selected_record' WHEN t.st <> 'committed' THEN 'not_committed' END AS why
  FROM (SELECT case_id, tx, st FROM mkn UNION ALL SELECT case_id, 'TX-SYNTH-00000' || CAST(f AS VARCHAR) || '@' || CAST(s AS VARCHAR), 'incomplete' FROM syn) t),
sev AS MATERIALIZED (SELECT e.case_id, e.f, e.pos, e.ri, CASE WHEN o.f IS NOT NULL THEN 'of_selected_record' WHEN g.by_tx THEN 'of_selected_transaction' WHEN g.f IS NULL THEN 'ungrouped' END AS why FROM ev e
  LEFT JOIN (SELECT DISTINCT r.case_id, r.f, r.pos, r.ri FROM rev r JOIN sel s ON s.case_id = r.case_id AND s.key = r.key) o ON o.case_id = e.case_id AND o.f = e.f AND o.pos = e.pos AND o.ri = e.ri
  LEFT JOIN (SELECT t.case_id, t.f, t.pos, t.ri, bool_or(x.why IS NOT NULL) AS by_tx FROM tev t JOIN str x ON x.case_id = t.case_id AND x.tx = t.tx GROUP BY ALL) g ON g.case_id = e.case_id AND g.f = e.f AND g.pos = e.pos AND g.ri = e.ri),
sro AS (SELECT n.case_id, n.so, n.sk, CASE WHEN s.key IS NOT NULL THEN 'key_of_selected_record' END AS why FROM sn n LEFT JOIN sel s ON s.case_id = n.case_id AND s.key = n.sk),
xs AS (SELECT r.case_id, 'records' AS section, CASE WHEN s.key IS NOT NULL THEN 'not_exact' END AS reason FROM rolled r LEFT JOIN sel s ON s.case_id = r.case_id AND s.key = r.key UNION ALL SELECT case_id, 'fields', CASE WHEN res <> 'Exact' THEN 'not_exact' END FROM vr
  UNION ALL SELECT case_id, 'transactions', why FROM str UNION ALL SELECT case_id, 'events', why FROM sev UNION ALL SELECT case_id, 'snapshot_rows', why FROM sro)
"""


def _selection(c: Case, a: Analysis, **more) -> export.Selection:
    g = a.grouping
    return export.select(a.record_verdicts, a.field_verdicts, a.correlation.record_events, g.transactions, g.tx_events, g.events, identity.snapshot_keys(c.snapshot, c.catalog), **more)


STATUS = "CASE WHEN reason IS NOT NULL THEN 'included' ELSE 'summarised' END"
query("g16_selection_counts", chain(SELECTED + f"SELECT case_id, section, {STATUS} AS status, reason, count(*) AS n FROM xs GROUP BY ALL"), "both")(lambda c, a: export.counts(_selection(c, a)))
query("g16_selection_of_two_sections", chain(SELECTED + f"SELECT case_id, section, CASE WHEN section IN ('records', 'fields') THEN {STATUS} ELSE 'excluded' END AS status, CASE WHEN section IN ('records', 'fields') THEN reason END AS reason, count(*) AS n FROM xs GROUP BY ALL"), "both")(
    lambda c, a: export.counts(_selection(c, a, sections=("records", "fields")))
)
query("g16_selected_transactions", chain(SELECTED + "SELECT case_id, tx AS tx_id, why AS reason FROM str WHERE why IS NOT NULL"), "both")(lambda c, a: _selection(c, a).transactions.filter("status = 'included'").select("case_id", "tx_id", "reason"))
query("g16_selected_events", chain(SELECTED + "SELECT case_id, " + FILE.format("f") + " AS source_file, pos AS log_position, CAST(ri AS BIGINT) AS row_index, why AS reason FROM sev WHERE why IS NOT NULL"), "both")(
    lambda c, a: _selection(c, a).events.filter("status = 'included'").select("case_id", "source_file", "log_position", F.col("row_index").cast("long").alias("row_index"), "reason")
)
query("g16_selected_snapshot_rows", chain(SELECTED + "SELECT case_id, CAST(sk AS VARCHAR) AS pk, so AS snapshot_ord FROM sro WHERE why IS NOT NULL"), "both")(lambda c, a: _selection(c, a).snapshot_rows.filter("status = 'included'").select("case_id", "pk", "snapshot_ord"))

# --- G18: redaction ---------------------------------------------------------------------------------------------------


def _shown_snapshot(c: Case):
    """The snapshot with NULLs, columns that were not observed and a free text beside the undecodable values that it has."""
    k = F.floor(F.col("snapshot_ord") / 10)
    image = F.map_filter("values", lambda name, _: ~((name == "o_orderpriority") & (k % 19 == 0)))
    image = F.transform_values(image, lambda name, v: F.when((name == "o_custkey") & (k % 17 == 0), values.value("null", F.lit(None))).otherwise(v))
    return c.snapshot.select("case_id", "snapshot_ord", "table", F.when(k % 23 == 0, "Unknown").otherwise(F.col("database")).alias("database"), "is_deleted", image.alias("image"), F.when(k % 3 == 0, F.concat(F.lit("seen at "), k.cast("string"))).alias("note"))


def _redacted(c: Case):
    rules = {"case_id": redaction.KEEP, "snapshot_ord": redaction.KEEP, "table": "TABLE", "database": "DATABASE", "is_deleted": redaction.KEEP, "image": redaction.IMAGE, "note": redaction.WITHHOLD}
    return redaction.redact({"snapshot": _shown_snapshot(c)}, {"snapshot": rules})[0]["snapshot"]


_ALIAS = "'[{0}-' || CASE WHEN length(CAST(n AS VARCHAR)) < 3 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END || ']'"
query(
    "g18_redacted_snapshot",
    chain(
        """,
sx AS (SELECT *, so // 10 AS kk FROM sn),
vals AS (SELECT case_id, so, kk, del, 'o_orderkey' AS field, 'int' AS kind, CAST(sk AS VARCHAR) AS text FROM sx UNION ALL SELECT case_id, so, kk, del, 'o_custkey', CASE WHEN kk % 17 = 0 THEN 'null' ELSE 'int' END, CASE WHEN kk % 17 <> 0 THEN CAST(custkey AS VARCHAR) END FROM sx
  UNION ALL SELECT case_id, so, kk, del, 'o_orderstatus', CASE WHEN broken THEN 'undecodable' ELSE 'str' END, CASE WHEN broken THEN 'bad length' ELSE status END FROM sx UNION ALL SELECT case_id, so, kk, del, 'price_cents', 'int', CAST(price AS VARCHAR) FROM sx
  UNION ALL SELECT case_id, so, kk, del, 'o_orderpriority', 'str', prio FROM sx WHERE kk % 19 <> 0),
va AS (SELECT text, """
        + _ALIAS.format("VALUE")
        + """ AS alias FROM (SELECT text, row_number() OVER (ORDER BY text) AS n FROM (SELECT DISTINCT text FROM vals WHERE kind NOT IN ('null', 'undecodable')))),
fa AS (SELECT field, """
        + _ALIAS.format("FIELD")
        + """ AS alias FROM (SELECT field, row_number() OVER (ORDER BY field) AS n FROM (SELECT DISTINCT field FROM vals)))
SELECT v.case_id, v.so AS snapshot_ord, '[TABLE-001]' AS "table", CASE WHEN v.kk % 23 = 0 THEN 'Unknown' ELSE '[DATABASE-001]' END AS "database", v.del AS is_deleted, CASE WHEN v.kk % 3 = 0 THEN '[REDACTED]' END AS note, fa.alias AS field,
  CASE WHEN v.kind IN ('null', 'undecodable') THEN v.kind ELSE 'alias' END AS kind, CASE WHEN v.kind = 'undecodable' THEN '[REDACTED]' ELSE va.alias END AS text FROM vals v JOIN fa ON fa.field = v.field LEFT JOIN va ON va.text = v.text AND v.kind NOT IN ('null', 'undecodable')"""
    ),
    "case",
)(lambda c: _redacted(c).select("case_id", "snapshot_ord", "table", "database", "is_deleted", "note", F.explode("image").alias("field", "v")).select("*", "v.kind", "v.text").drop("v"))

# --- R12, T15: the run behind each value -------------------------------------------------------------------------------


def _runs(c: Case):
    """Runs derived from the log: every file but the third was decoded, the second again from 5,000 on, the fifth also in vain."""
    files = c.events.groupBy("case_id", "source_file").agg(F.min("log_position").alias("at")).withColumn("n", F.substring("source_file", -1, 1))
    run = lambda cond, name, position, started, status: files.filter(cond).select("case_id", F.concat(F.lit(name), "n").alias("run_id"), F.concat(F.lit("/work/"), "source_file").alias("source_file"), F.lit(position).cast("long").alias("from_position"), F.lit(started).alias("started"), F.lit(status).alias("status"))
    return run("n <> '3'", "first-", 0, 1, "ok").unionByName(run("n = '2'", "again-", 5000, 2, "ok")).unionByName(run("n = '5'", "broken-", 0, 3, "failed"))


RUN = "CASE WHEN {0} = 3 THEN NULL WHEN {0} = 2 AND {1} >= 5000 THEN 'again-2' ELSE 'first-' || CAST({0} AS VARCHAR) END"
query(
    "r12_field_runs",
    chain(
        PROVENANCE
        + """, fst AS (SELECT case_id, key, arg_min(f, ord) AS ff, arg_min(pos, ord) AS fp, arg_min(ri, ord) AS fr FROM rev GROUP BY ALL),
fp AS (SELECT d.case_id, d.key, d.col, coalesce(p.pf, t.ff) AS f, coalesce(p.pp, t.fp) AS pos, coalesce(p.pr, t.fr) AS ri, CASE WHEN p.pf IS NULL THEN 'before_image' ELSE 'set_by_event' END AS basis FROM fld d JOIN prov p ON p.case_id = d.case_id AND p.key = d.key AND p.col = d.col JOIN fst t ON t.case_id = d.case_id AND t.key = d.key WHERE d.has_log)
SELECT case_id, CAST(key AS VARCHAR) AS pk, col AS field, """
        + FILE.format("f")
        + " AS source_file, pos AS log_position, CAST(ri AS BIGINT) AS row_index, "
        + RUN.format("f", "pos")
        + " AS run_id, basis FROM fp"
    ),
    "both",
)(lambda c, a: rec(provenance.field_provenance(a.history.states, a.correlation.record_events, a.grouping.events, _runs(c)), F.col("column").alias("field"), "source_file", "log_position", F.col("row_index").cast("long").alias("row_index"), "run_id", "basis"))
query("t15_event_runs", chain("SELECT case_id, " + RUN.format("f", "pos") + " AS run_id, " + FILE.format("f") + " AS source_file, CASE WHEN f <> 3 THEN 'recorded' END AS run_basis, count(*) AS events FROM ev GROUP BY ALL"), "both")(
    lambda c, a: provenance.event_runs(a.grouping.events, _runs(c)).groupBy("case_id", "run_id", "source_file", "run_basis").agg(F.count("*").alias("events"))
)
query("t15_provenance_findings", chain("SELECT DISTINCT case_id, 'R-PROV-001' AS rule_id, " + FILE.format("f") + " AS subject, 'warning' AS severity, 'No tool run recorded for ' || " + FILE.format("f") + " AS text FROM ev WHERE f = 3"), "case")(
    lambda c: rules.described(provenance.missing_runs(c.events, _runs(c))).select("case_id", "rule_id", "subject", "severity", "text")
)

# --- Q04, V09, P04: two analyses, stale results, counts ----------------------------------------------------------------


def _shuffled(c: Case) -> Case:
    return replace(c, **{f.name: getattr(c, f.name).repartition(5) for f in fields(c) if getattr(c, f.name) is not None})


def _results(a: Analysis) -> dict:
    return {"transactions": a.grouping.transactions, "tx_events": a.grouping.tx_events, "records": a.correlation.records, "states": a.history.states, "field_verdicts": a.field_verdicts, "record_verdicts": a.record_verdicts, "findings": a.findings}


query(
    "q04_two_analyses",
    chain(
        "SELECT result, case_id, count(*) AS rows, true AS same FROM (SELECT 'transactions' AS result, case_id FROM mkn UNION ALL SELECT 'transactions', case_id FROM syn UNION ALL SELECT 'tx_events', case_id FROM tev UNION ALL SELECT 'records', case_id FROM rm UNION ALL SELECT 'field_verdicts', case_id FROM vr UNION ALL SELECT 'record_verdicts', case_id FROM rolled"
        " UNION ALL SELECT 'findings', case_id FROM (" + FOUND + ") UNION ALL SELECT 'states', case_id FROM (SELECT DISTINCT case_id, key, col FROM fld WHERE logged AND (col IN ('o_orderkey', 'price_cents') OR t0 <> 'INSERT' OR EXISTS (SELECT 1 FROM rev r WHERE r.case_id = fld.case_id AND r.key = fld.key AND r.part = 0)))) GROUP BY ALL"
    ),
    "both",
)(lambda c, a: stale.same_results(_results(a), _results(analyse(_shuffled(c)))))


def _changed(c: Case) -> Case:
    """Case A without some rows of its snapshot, case B with one column of its markers moved."""
    gone = (F.col("case_id") == "A") & (F.col("snapshot_ord") % 7 == 0)
    return replace(c, snapshot=c.snapshot.filter(~gone), markers=c.markers.withColumn("end_position", F.col("end_position") + F.when((F.col("case_id") == "B") & (F.col("end_position") % 3 == 0), 1).otherwise(0)))


CHANGED = "sc AS (SELECT DISTINCT case_id, 'snapshot' AS input FROM sn WHERE case_id = 'A' AND so % 7 = 0 UNION SELECT DISTINCT case_id, 'markers' FROM mk WHERE case_id = 'B' AND e % 3 = 0)"
NEEDS = "(VALUES ('grouping', 'markers'), ('correlation', 'markers'), ('correlation', 'snapshot'), ('reconstruction', 'markers'), ('reconstruction', 'snapshot'), ('reconciliation', 'markers'), ('reconciliation', 'snapshot')) n(stage, input)"
query("v09_stale_stages", chain(", " + CHANGED + " SELECT case_id, stage, string_agg(input, ', ' ORDER BY input) AS changed FROM sc JOIN " + NEEDS + " USING (input) GROUP BY ALL"), "case")(lambda c: stale.stale(stale.inputs(c), stale.inputs(_changed(c))))


def _still_fresh(c: Case, a: Analysis):
    then, now = stale.made_from(stale.inputs(c)), stale.made_from(stale.inputs(_changed(c)))
    kept = {"grouping": a.grouping.transactions, "reconciliation": a.record_verdicts}
    return reduce(DataFrame.unionByName, [stale.fresh(stale.stamped(df.select("case_id"), s, then), s, now).groupBy("case_id", F.lit(s).alias("stage")).agg(F.count("*").alias("rows")) for s, df in kept.items()])


query("v09_fresh_rows", chain(", " + CHANGED + " SELECT case_id, stage, count(*) AS rows FROM (SELECT case_id, 'grouping' AS stage FROM mkn UNION ALL SELECT case_id, 'grouping' FROM syn UNION ALL SELECT case_id, 'reconciliation' FROM rolled) r WHERE NOT EXISTS (SELECT 1 FROM sc JOIN " + NEEDS + " USING (input) WHERE sc.case_id = r.case_id AND n.stage = r.stage) GROUP BY ALL"), "both")(_still_fresh)
query(
    "p04_scope_counts",
    chain("SELECT s.case_id, s.kind, coalesce(i.n, 0) AS in_scope, s.n AS stored FROM (SELECT case_id, kind, count(*) AS n FROM (SELECT case_id, 'events' AS kind FROM ev1 UNION ALL SELECT case_id, 'markers' FROM mk UNION ALL SELECT case_id, 'physical_records' FROM sn UNION ALL SELECT DISTINCT case_id, 'schemas' FROM ev1) GROUP BY ALL) s LEFT JOIN (SELECT case_id, kind, count(*) AS n FROM (SELECT case_id, 'events' AS kind FROM ev1 WHERE f <= 4 UNION ALL SELECT case_id, 'markers' FROM mk WHERE f <= 4 UNION ALL SELECT case_id, 'physical_records' FROM sn UNION ALL SELECT DISTINCT case_id, 'schemas' FROM ev1) GROUP BY ALL) i ON i.case_id = s.case_id AND i.kind = s.kind"),
    "case",
)(lambda c: stale.scope_counts(replace(c, events=c.events.filter("source_file <= 'log.000004'"), markers=c.markers.filter("source_file <= 'log.000004'")), c))

# --- S01 to S09: logs and dumps written as text and read again -----------------------------------------------------------


def _log_markers(c: Case) -> DataFrame:
    """A transaction around the events of each file and time of the derived log."""
    h = F.floor(F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2026-08-15 19:06:25").cast("timestamp")))
    status = F.when(F.col("h") % 11 == 3, "rolled_back").when(F.col("h") % 17 == 5, "incomplete").otherwise("committed")
    spans = c.events.withColumn("h", h).groupBy("case_id", "source_file", "h").agg((F.min("log_position") - 2).alias("start_position"), (F.max("log_position") + 8).alias("end_position"), F.min("ts").alias("ts"))
    return spans.select("case_id", "source_file", "start_position", "end_position", status.alias("status"), F.concat(F.lit("aa-bb:"), F.col("h").cast("string")).alias("gtid"), F.col("h").alias("xid"), (13 + F.col("h") % 5).alias("thread_id"), "ts")


def _read_back(s, d: str):
    """(notes, events) of the derived log, each event once, written as text in pieces and read by the log reader."""
    c = derive(s, d)
    path = f"{shared_dir(s)}/ledgerline/{uuid.uuid4().hex}"
    lines = render.change_log(transactions.deduplicate(c.events)[0], _log_markers(c), c.catalog)
    render.write_pieces(lines.withColumn("log", F.concat_ws("-", "case_id", "source_file")), path, ["place", "line_no"])
    notes = text.annotated(text.read_lines(s, path, in_pieces=True))
    return notes, text.change_log_events(notes, c.catalog.filter("case_id = 'A'"))


def _place(df: DataFrame, *more):
    return df.select(F.substring_index("source_file", "-", 1).alias("case_id"), F.substring_index("source_file", "-", -1).alias("source_file"), *more)


def _log_events(s, d: str):
    price = lambda side: F.col(side)["price_cents"]["text"].cast("long")
    key = lambda side: F.col(side)["o_orderkey"]["text"].cast("long")
    return _place(_read_back(s, d)[1], "log_position", F.col("row_index").cast("long").alias("row_index"), "event_type", "database", "table", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "gtid", "thread_id", key("before").alias("key_before"), key("after").alias("key_after"), price("before").alias("price_before"), price("after").alias("price_after"), F.col("after")["o_orderpriority"]["text"].alias("priority"))


query(
    "s01_log_events",
    chain("SELECT case_id, " + FILE.format("f") + " AS source_file, pos AS log_position, row_number() OVER (PARTITION BY case_id, f, pos ORDER BY ri) - 1 AS row_index, ty AS event_type, 'shop' AS \"database\", 'orders' AS \"table\", strftime(TIMESTAMP '2026-08-15 19:06:25' + to_seconds(h), '%Y-%m-%d %H:%M:%S') AS ts, 'aa-bb:' || CAST(h AS VARCHAR) AS gtid, 13 + h % 5 AS thread_id, bk AS key_before, ak AS key_after, bp AS price_before, ap AS price_after, CASE WHEN part = 0 AND ty <> 'DELETE' THEN prio END AS priority FROM ev"),
    "tables",
)(_log_events)
query(
    "s06_log_transactions",
    chain("SELECT case_id, " + FILE.format("f") + " AS source_file, min(pos) - 2 AS start_position, CASE WHEN h % 11 <> 3 AND h % 17 = 5 THEN NULL ELSE max(pos) + 8 END AS end_position, CASE WHEN h % 11 = 3 THEN 'rolled_back' WHEN h % 17 = 5 THEN 'incomplete' ELSE 'committed' END AS status, 'aa-bb:' || CAST(h AS VARCHAR) AS gtid, CASE WHEN h % 11 <> 3 AND h % 17 <> 5 THEN h END AS xid, 13 + h % 5 AS thread_id, count(DISTINCT pos) AS positions FROM ev GROUP BY case_id, f, h"),
    "tables",
)(lambda s, d: (lambda n, e: _place(text.transaction_markers(n, e), "start_position", F.when(F.col("status") != "incomplete", F.col("end_position")).alias("end_position"), "status", "gtid", "xid", "thread_id", F.size("event_positions").cast("long").alias("positions")))(*_read_back(s, d)))


def _dumped(s, d: str) -> DataFrame:
    path = f"{shared_dir(s)}/ledgerline/{uuid.uuid4().hex}"
    lines = render.snapshot_dump(derive(s, d).snapshot)
    render.write_pieces(lines.withColumn("log", F.concat_ws("-", "case_id", F.when(F.col("is_deleted"), "deleted").otherwise("live"))), path, ["snapshot_ord"])
    read = text.read_lines(s, path, in_pieces=True)
    return text.snapshot_inserts(read.filter("file like '%-live'"))[0].unionByName(text.snapshot_inserts(read.filter("file like '%-deleted'"), deleted=True)[0])


query("s08_snapshot_rows", chain("SELECT case_id, 'shop' AS \"database\", 'orders' AS \"table\", del AS is_deleted, sk AS pk, price, prio AS priority, CASE WHEN broken THEN NULL ELSE status END AS status, row_number() OVER (PARTITION BY case_id, del ORDER BY so) AS line FROM sn"), "tables")(
    lambda s, d: _dumped(s, d).select(F.substring_index("file", "-", 1).alias("case_id"), "database", "table", "is_deleted", F.col("values")["o_orderkey"]["text"].cast("long").alias("pk"), F.col("values")["price_cents"]["text"].cast("long").alias("price"), F.col("values")["o_orderpriority"]["text"].alias("priority"), F.when(F.col("values")["o_orderstatus"]["kind"] == "str", F.col("values")["o_orderstatus"]["text"]).alias("status"), F.col("snapshot_ord").alias("line"))
)

# --- V01, V02, G03, G09, G12, G17, P07, Q02, Q09, S14, T06: the rest of what is shown and counted ------------------------

GRAPH = (
    PROVENANCE
    + f""",
fx AS (SELECT DISTINCT f.case_id, f.rule_id, f.subject, f.text, c.severity FROM ({FOUND}) f JOIN {CATALOGUE} ON c.id = f.rule_id WHERE c.severity <> 'info'),
fj AS (SELECT *, CAST(json_object('rule_id', rule_id, 'severity', severity, 'subject', subject, 'text', text) AS VARCHAR) AS j FROM fx)
SELECT case_id, 'correlation' AS stage, 'graph_records' AS kind, row_number() OVER (PARTITION BY case_id ORDER BY key) - 1 AS ordinal, 'orders:' || CAST(key AS VARCHAR) AS identity, '' AS bucket, CAST(json_object('record', 'orders:' || CAST(key AS VARCHAR), 'method', method) AS VARCHAR) AS summary, CAST(json_object('record', 'orders:' || CAST(key AS VARCHAR), 'method', method, 'candidates', cands, 'live', live) AS VARCHAR) AS detail FROM rm
UNION ALL SELECT case_id, 'correlation', 'graph_edges', row_number() OVER (PARTITION BY case_id ORDER BY tx, key, ty) - 1, 'orders:' || CAST(key AS VARCHAR), tx, CAST(json_object('tx_id', tx, 'record_id', 'orders:' || CAST(key AS VARCHAR), 'event_type', ty) AS VARCHAR), CAST(json_object('tx_id', tx, 'record_id', 'orders:' || CAST(key AS VARCHAR), 'event_type', ty) AS VARCHAR) FROM (SELECT DISTINCT case_id, tx, key, ty FROM rev WHERE tx IS NOT NULL)
UNION ALL SELECT r.case_id, 'reconstruction', 'histories', row_number() OVER (PARTITION BY r.case_id ORDER BY r.key) - 1, 'orders:' || CAST(r.key AS VARCHAR), 'orders', CAST(json_object('record', 'orders:' || CAST(r.key AS VARCHAR), 'method', r.method, 'step_count', s.n) AS VARCHAR), CAST(json_object('record', 'orders:' || CAST(r.key AS VARCHAR), 'method', r.method, 'step_count', s.n, 'candidates', r.cands) AS VARCHAR) FROM rm r JOIN (SELECT case_id, pk, count(*) AS n FROM ({STEPS}) GROUP BY ALL) s ON s.case_id = r.case_id AND s.pk = CAST(r.key AS VARCHAR)
UNION ALL SELECT t.case_id, 'grouping', 'events', row_number() OVER w - 1, CAST(row_number() OVER w - 1 AS VARCHAR), t.tx, CAST(json_object('source_file', {FILE.format("t.f")}, 'log_position', t.pos, 'row_index', t.ri) AS VARCHAR), CAST(json_object('source_file', {FILE.format("t.f")}, 'log_position', t.pos, 'row_index', t.ri, 'event_type', e.ty, 'durable', t.dur) AS VARCHAR) FROM tev t JOIN ev e ON e.case_id = t.case_id AND e.f = t.f AND e.pos = t.pos AND e.ri = t.ri WINDOW w AS (PARTITION BY t.case_id, t.tx ORDER BY t.f, t.pos, t.ri)
UNION ALL SELECT case_id, 'all', 'findings', row_number() OVER (PARTITION BY case_id ORDER BY rule_id, subject, text) - 1, sha256(j), CAST(json_array(rule_id, severity) AS VARCHAR), j, j FROM fj"""
)


def _told(a: Analysis) -> DataFrame:
    return rules.described(rules.distinct_findings(a.findings))


query("v01_graph_items", chain(GRAPH))(
    lambda a: serving.graph_items(a.correlation.records, identity.edges(a.correlation.record_events), history.all_steps(a.correlation.record_events, a.correlation.records, a.correlation.aliases, a.gaps), a.grouping.tx_events, _told(a))
)
query("v02_history_counts_by_table", chain("SELECT rl.case_id, 'shop' AS \"database\", 'orders' AS \"table\", count(*) AS histories, count(con.key) AS contradicted, count(*) FILTER (WHERE part) AS partial FROM rl LEFT JOIN con ON con.case_id = rl.case_id AND con.key = rl.key GROUP BY ALL"))(lambda a: reports.history_counts(a.history.records))
query(
    "g03_ranked_groups",
    chain(
        OBSERVED
        + ", gs AS (SELECT case_id, rule_id, severity, subject, CASE WHEN file = 'log.000007' THEN NULL ELSE CAST(regexp_extract(file, '([0-9]+)$', 1) AS INTEGER) END AS gf, coalesce(lp, 0) AS gp FROM fn) SELECT case_id, rule_id, severity, CAST(list_position(['warning', 'notice', 'info'], severity) AS INTEGER) AS rank, count(*) AS occurrences, count(DISTINCT subject) AS subjects, coalesce(string_agg(DISTINCT "
        + "CASE WHEN gf IS NOT NULL THEN " + RUN.format("gf", "gp") + " END, ', ' ORDER BY CASE WHEN gf IS NOT NULL THEN " + RUN.format("gf", "gp") + " END), '') AS runs FROM gs WHERE severity <> 'info' GROUP BY ALL"
    ),
    "both",
)(lambda c, a: reports.ranked_groups(_told(a).filter("severity <> 'info'"), provenance.run_of(_runs(c))))
query(
    "g12_case_metrics",
    chain("SELECT r.case_id, 1 AS tables, 5 AS columns, 1 AS verified, 7 AS pages, 0 AS damaged, CASE WHEN r.case_id = 'B' THEN 1 ELSE 0 END AS missing_logs, (SELECT count(*) FROM mkn m WHERE m.case_id = r.case_id) + (SELECT count(*) FROM syn s WHERE s.case_id = r.case_id) AS transactions, count(*) AS records, (SELECT count(*) FROM vr v WHERE v.case_id = r.case_id AND v.res = 'Exact') AS exact, (SELECT count(*) FROM vr v WHERE v.case_id = r.case_id AND v.res = 'Unresolved') AS unresolved FROM rolled r GROUP BY r.case_id"),
    "both",
)(lambda c, a: reports.case_preview(c.catalog, c.health, c.log_files, a.grouping.transactions, a.reconciliation.records))
query(
    "p07_listings",
    chain(
        OBSERVED
        + ", tx AS (SELECT m.case_id, m.tx, CASE WHEN c.n IS NULL THEN 'marker_without_events' ELSE 'log_file_missing_in_sequence' END AS reason FROM mkn m LEFT JOIN (SELECT case_id, mh, count(*) AS n FROM cl GROUP BY ALL) c ON c.case_id = m.case_id AND c.mh = m.h WHERE m.st = 'incomplete' UNION ALL SELECT case_id, 'TX-SYNTH-00000' || CAST(f AS VARCHAR) || '@' || CAST(s AS VARCHAR), 'events_without_begin' FROM syn)"
        " SELECT case_id, 'deleted' AS listing, 'shop.orders' AS bucket, CAST(so AS VARCHAR) AS identity FROM sn WHERE del UNION ALL SELECT case_id, 'incomplete', reason, tx FROM tx UNION ALL SELECT DISTINCT case_id, 'damaged', 'damaged', 'shop.orders' FROM sn WHERE case_id = 'B' UNION ALL SELECT case_id, 'finding', rule_id, subject FROM fn WHERE severity <> 'info'"
    ),
    "both",
)(lambda c, a: reports.listings(c.snapshot, a.grouping.transactions, c.health.withColumn("status", F.when(F.col("case_id") == "B", "damaged").otherwise(F.col("status"))), _told(a).filter("severity <> 'info'")))


def _expected(s, d: str) -> DataFrame:
    """What the orders say of each record's price and status: where the snapshot was made to differ, and where it is broken."""
    agree = F.array(F.lit("Exact"), F.lit("Strong"))
    k = F.col("k")
    price = F.struct(F.lit("price_cents").alias("column"), F.when(k % 29 == 0, F.array(F.lit("Conflicting"))).otherwise(agree).alias("allowed"))
    state = F.struct(F.lit("o_orderstatus").alias("column"), F.when(k % 47 == 0, F.array(F.lit("Unsupported"))).otherwise(agree).alias("allowed"))
    return base(s, d).select("case_id", k.cast("string").alias("pk"), F.explode(F.array(price, state)).alias("x")).select("case_id", "pk", "x.*")


_ALLOWED = "SELECT case_id, k, 'price_cents' AS col, CASE WHEN k % 29 = 0 THEN ['Conflicting'] ELSE ['Exact', 'Strong'] END AS allowed FROM o2 UNION ALL SELECT case_id, k, 'o_orderstatus', CASE WHEN k % 47 = 0 THEN ['Unsupported'] ELSE ['Exact', 'Strong'] END FROM o2"
query(
    "q02_scored_against_orders",
    chain(
        f", ex AS ({_ALLOWED}), me AS (SELECT e.*, v.res FROM ex e LEFT JOIN vr v ON v.case_id = e.case_id AND v.key = e.k AND v.col = e.col) SELECT count(*) AS expected, count(*) FILTER (WHERE res IS NULL) AS missing, count(*) FILTER (WHERE list_contains(allowed, res)) AS right_, count(*) FILTER (WHERE res = 'Conflicting' AND NOT list_contains(allowed, 'Conflicting')) AS false_alarms, count(*) FILTER (WHERE allowed = ['Conflicting']) AS conflicts_expected,"
        " count(*) FILTER (WHERE allowed = ['Conflicting'] AND res <> 'Conflicting') AS missed_conflicts, count(*) FILTER (WHERE res = 'Unresolved' AND allowed = ['Exact', 'Strong']) AS inconclusive, count(*) FILTER (WHERE res = 'Unsupported' AND NOT list_contains(allowed, 'Unsupported')) AS wrongly_unsupported FROM me"
    ),
    "tables",
)(lambda s, d: quality.scored(_expected(s, d), analysis_of(s, d).field_verdicts, ["case_id", "pk", "column"]))
query(
    "q09_profiles",
    chain(OBSERVED + "SELECT case_id, 'events' AS section, '' AS value, count(*) AS n FROM ev GROUP BY ALL UNION ALL SELECT case_id, 'positions', '', count(DISTINCT (f, pos)) FROM ev GROUP BY ALL UNION ALL SELECT case_id, 'markers', st, count(*) FROM mk GROUP BY ALL UNION ALL SELECT case_id, 'findings', severity, count(*) FROM fn WHERE severity <> 'info' GROUP BY ALL"),
    "both",
)(lambda c, a: quality.profiles(a.grouping.events, c.markers, _told(a).filter("severity <> 'info'")))
query("t06_tables_touched", chain("SELECT case_id, tx AS tx_id, string_agg(DISTINCT 'shop.t' || CAST(pos // 100 % 3 AS VARCHAR), ', ' ORDER BY 'shop.t' || CAST(pos // 100 % 3 AS VARCHAR)) AS tables FROM tev GROUP BY ALL"))(
    lambda a: transactions.tables_touched(a.grouping.tx_events, a.grouping.events.withColumn("table", F.concat(F.lit("t"), (F.floor(F.col("log_position") / 100) % 3).cast("string")))).select("case_id", "tx_id", F.array_join("tables", ", ").alias("tables"))
)


def _inventory(s, d: str) -> DataFrame:
    """Files listed by items of orders against files found, which items of large quantity stand for."""
    items = read(s, d, "lineitem").join(read(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    name = lambda folder, at: F.concat(F.lit(folder), F.lit("log."), F.col("l_orderkey").cast("string"), F.lit("-"), at.cast("string")).alias("file")
    case_id = F.col("o_custkey").cast("string").alias("case_id")
    return text.inventory(items.select(case_id, name("/var/log/", F.floor(F.col("l_linenumber") / 2))), items.filter("l_quantity > 25").select(case_id, name("C:\\evidence\\", F.floor((F.col("l_linenumber") + 1) / 2))))


query(
    "s14_inventory",
    "WITH it AS (SELECT CAST(o_custkey AS VARCHAR) AS case_id, 'log.' || CAST(l_orderkey AS VARCHAR) || '-' AS b, l_linenumber AS n, l_quantity AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey), l AS (SELECT DISTINCT case_id, b || CAST(n // 2 AS VARCHAR) AS file FROM it), p AS (SELECT DISTINCT case_id, b || CAST((n + 1) // 2 AS VARCHAR) AS file FROM it WHERE q > 25)"
    " SELECT coalesce(l.case_id, p.case_id) AS case_id, coalesce(l.file, p.file) AS file, CASE WHEN p.file IS NULL THEN 'missing' WHEN l.file IS NULL THEN 'unlisted' ELSE 'present' END AS status FROM l FULL JOIN p ON p.case_id = l.case_id AND p.file = l.file",
    "tables",
)(_inventory)
query("g17_unselected_catalogs", "SELECT CAST(l_orderkey AS VARCHAR) AS case_id, count(*) AS columns, coalesce(string_agg('c1', ',') FILTER (WHERE l_linenumber = 1), '') AS key FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_orderkey", "tables")(
    lambda s, d: reports.unselected_catalogs(catalogs(s, d), read(s, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("case_id"), F.lit("shop").alias("database"), F.lit("items").alias("table"))).select("case_id", "columns", "key")
)

# --- G04, G10, Q03, Q07 over findings, runs and verdicts -----------------------------------------------------------------


def _entries(c: Case, a: Analysis) -> DataFrame:
    """Findings that are more than information with the run that decoded the file they name."""
    held = lambda key: F.when(F.col("context")[key] != "", F.col("context")[key])
    named = _told(a).filter("severity <> 'info'").withColumns({"source_file": F.coalesce(held("source_file"), F.lit("")), "log_position": F.coalesce(held("log_position").cast("long"), F.lit(0))})
    return provenance.event_runs(named.drop("context"), _runs(c))


query(
    "g04_finding_entries",
    chain(OBSERVED + ", gs AS (SELECT case_id, rule_id, coalesce(file, '') AS source_file, CASE WHEN file IS NULL OR file = 'log.000007' THEN NULL ELSE " + RUN.format("CAST(regexp_extract(file, '([0-9]+)$', 1) AS INTEGER)", "coalesce(lp, 0)") + " END AS run_id FROM fn WHERE severity <> 'info') SELECT case_id, rule_id, source_file, run_id, count(*) AS entries FROM gs GROUP BY ALL"),
    "both",
)(lambda c, a: _entries(c, a).groupBy("case_id", "rule_id", "source_file", "run_id").agg(F.count("*").alias("entries")))
query(
    "g10_runs_by_status",
    chain("SELECT case_id, run_id, rs AS status, count(*) AS events, min(pos) AS first_position, max(pos) AS last_position FROM (SELECT case_id, pos, " + RUN.format("f", "pos") + " AS run_id, CASE WHEN f <> 3 THEN 'ok' END AS rs FROM ev) GROUP BY ALL"),
    "both",
)(lambda c, a: provenance.event_runs(a.grouping.events, _runs(c)).join(_runs(c).select("case_id", "run_id", "status"), ["case_id", "run_id"], "left").groupBy("case_id", "run_id", "status").agg(F.count("*").alias("events"), F.min("log_position").alias("first_position"), F.max("log_position").alias("last_position")))
def _transaction_accuracy(c: Case, a: Analysis) -> DataFrame:
    """Ids may be shared by transactions of different files, so the place of the marker is part of the key."""
    key = [*transactions.MARKER, "tx_id"]
    return quality.accuracy(transactions.named(c.markers).select(*key, "status"), a.grouping.transactions.select(*key, "status"), key, "status")


query(
    "q03_transaction_accuracy",
    chain("SELECT count(*) FILTER (WHERE x.tx IS NOT NULL) AS right_, 0 AS wrong, 0 AS missing, (SELECT count(*) FROM syn) AS \"unexpected\" FROM mkn x"),
    "both",
)(_transaction_accuracy)
query(
    "q03_verdict_accuracy",
    chain("SELECT count(*) FILTER (WHERE v.res = 'Conflicting') AS right_, count(*) FILTER (WHERE v.res <> 'Conflicting') AS wrong, count(*) FILTER (WHERE v.res IS NULL) AS missing, (SELECT count(*) FROM vr WHERE col = 'price_cents' AND key NOT IN (SELECT k FROM o2 WHERE o2.case_id = vr.case_id AND k % 29 = 0)) AS \"unexpected\" FROM o2 LEFT JOIN vr v ON v.case_id = o2.case_id AND v.key = o2.k AND v.col = 'price_cents' WHERE k % 29 = 0"),
    "tables",
)(lambda s, d: quality.accuracy(base(s, d).filter("k % 29 = 0").select("case_id", F.col("k").cast("string").alias("pk"), F.lit("Conflicting").alias("result")), analysis_of(s, d).field_verdicts.filter("column = 'price_cents'").select("case_id", "pk", "result"), ["case_id", "pk"], "result"))
query(
    "q07_decoded_counts",
    chain("SELECT case_id, " + FILE.format("f") + " AS source_file, count(*) AS want, count(*) FILTER (WHERE cp = 0) AS n FROM ev1 GROUP BY case_id, f HAVING count(*) <> count(*) FILTER (WHERE cp = 0)"),
    "both",
)(lambda c, a: quality.count_mismatch(a.grouping.events.groupBy("case_id", "source_file").agg(F.count("*").alias("n")), c.events.groupBy("case_id", "source_file").agg(F.count("*").alias("n")), ["case_id", "source_file"]))
