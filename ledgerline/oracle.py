"""The analysis restated in SQL over the driver's tables, from its own copy of the change log."""

from .functions.rules import SEVERAL_CONTINUATIONS
from .plans.change_log import SQL

CHAIN = (
    "WITH "
    + SQL
    + """,
mkn AS (SELECT *, 'TX-' || CASE WHEN case_id = 'B' THEN substr(uuid, 1, 8) || '-' ELSE '' END || CAST(f * 100000 + t AS VARCHAR) AS tx, 'log.00000' || CAST(f AS VARCHAR) AS file FROM mk),
pcl AS (SELECT e.case_id, e.f, e.pos, e.ri, m.tx, m.s, m.st, m.h AS mh FROM ev e JOIN mkn m ON m.case_id = e.case_id AND m.h = e.h WHERE NOT m.ses),
ser AS (SELECT m.case_id, m.f, e.pos, e.ri, e.th, m.th AS mth, m.tx, m.s, m.st, m.h AS mh FROM mkn m JOIN ev e ON e.case_id = m.case_id AND e.f = m.f AND e.pos BETWEEN m.s AND m.e
  LEFT JOIN mkn w ON w.case_id = e.case_id AND w.h = e.h AND NOT w.ses AND w.s < m.s WHERE m.ses AND w.h IS NULL),
ref AS (SELECT case_id, tx, count(*) AS n FROM ser GROUP BY case_id, tx HAVING count(*) > count(th)),
scl AS (SELECT case_id, f, pos, ri, tx, s, st, mh FROM ser WHERE th = mth AND (case_id, tx) NOT IN (SELECT case_id, tx FROM ref)),
cl AS (SELECT * FROM pcl UNION ALL SELECT * FROM scl),
fm AS (SELECT case_id, min(f * 1000000000000 + s) AS first_at FROM mk GROUP BY case_id),
loose AS (SELECT e.*, e.f * 1000000000000 + e.pos < fm.first_at AS ldg FROM ev e LEFT JOIN fm ON fm.case_id = e.case_id WHERE NOT EXISTS (SELECT 1 FROM cl WHERE cl.case_id = e.case_id AND cl.f = e.f AND cl.pos = e.pos AND cl.ri = e.ri)),
syn AS (SELECT case_id, min(f * 1000000000000 + pos) AS at, arg_min(pos, f * 1000000000000 + pos) AS s, arg_max(pos, f * 1000000000000 + pos * 100 + ri) AS e, count(*) AS n, min(f) AS f FROM loose WHERE ldg GROUP BY case_id),
tev AS (SELECT case_id, f, pos, ri, tx, s, st, st = 'committed' AS dur FROM cl UNION ALL SELECT l.case_id, l.f, l.pos, l.ri, 'TX-SYNTH-00000' || CAST(syn.f AS VARCHAR) || '@' || CAST(syn.s AS VARCHAR), syn.s, 'incomplete', false FROM loose l JOIN syn ON syn.case_id = l.case_id WHERE l.ldg),
one AS (SELECT case_id, f, pos, ri, arg_max(tx, s) AS tx, arg_max(dur, s) AS dur, arg_max(st, s) AS st FROM tev GROUP BY case_id, f, pos, ri),
evt AS (SELECT e.*, o.tx, coalesce(o.dur, false) AS dur, o.st, e.f * 1000000000000 + e.pos * 100 + e.ri AS ord FROM ev e LEFT JOIN one o ON o.case_id = e.case_id AND o.f = e.f AND o.pos = e.pos AND o.ri = e.ri),
chg AS (SELECT DISTINCT case_id, bk, ak FROM ev WHERE ty = 'UPDATE' AND bk <> ak),
fork AS (SELECT case_id, bk FROM chg GROUP BY case_id, bk HAVING count(*) > 1),
merge_ AS (SELECT case_id, ak FROM chg GROUP BY case_id, ak HAVING count(*) > 1),
amb AS (SELECT c.case_id, c.bk AS key FROM chg c JOIN fork USING (case_id, bk) UNION SELECT c.case_id, c.ak FROM chg c JOIN fork USING (case_id, bk) UNION SELECT c.case_id, c.ak FROM chg c JOIN merge_ USING (case_id, ak) UNION SELECT c.case_id, c.bk FROM chg c JOIN merge_ USING (case_id, ak)
  UNION SELECT a.case_id, a.bk FROM chg a JOIN chg b ON a.case_id = b.case_id AND a.bk = b.ak AND a.ak = b.bk),
ali AS (SELECT * FROM chg c WHERE NOT EXISTS (SELECT 1 FROM amb WHERE amb.case_id = c.case_id AND amb.key IN (c.bk, c.ak))),
ekey AS (SELECT e.*, coalesce(ak, bk) AS key FROM evt e UNION ALL SELECT e.*, bk FROM evt e WHERE ty = 'UPDATE' AND bk <> ak),
rev AS (SELECT DISTINCT e.* REPLACE (coalesce(a.ak, e.key) AS key) FROM ekey e LEFT JOIN ali a ON a.case_id = e.case_id AND a.bk = e.key),
cand AS (SELECT case_id, sk AS key, count(*) AS n, count(*) FILTER (WHERE NOT del) AS live, arg_min(so, CASE WHEN del THEN 1000000000000 ELSE 0 END + so) AS so FROM sn GROUP BY case_id, sk),
pick AS (SELECT c.case_id, c.key, c.n, c.live, s.so, s.del, s.price, s.broken FROM cand c LEFT JOIN sn s ON s.case_id = c.case_id AND s.so = c.so AND c.live <= 1),
rl AS (SELECT case_id, key, count(*) AS n_events, bool_or(part = 1 AND ty <> 'DELETE') AS part, arg_min(ty, ord) AS t0, arg_min(bp, ord) AS p0, max(ord) AS last_ord,
  arg_max(ap, ord) FILTER (WHERE dur AND ty <> 'DELETE') AS pd, arg_max(ap, ord) FILTER (WHERE ty <> 'DELETE') AS psp, arg_max(ty, ord) FILTER (WHERE dur) AS td, arg_max(ak, ord) FILTER (WHERE dur AND ty <> 'DELETE') AS kd, arg_min(bk, ord) AS k0 FROM rev GROUP BY case_id, key),
prior AS (SELECT r.case_id, r.key, r.ord, r.bp, r.bk, r.dur, last_value(CASE WHEN r.dur AND r.ty <> 'DELETE' THEN r.ak END IGNORE NULLS) OVER (PARTITION BY r.case_id, r.key ORDER BY r.ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS kv, last_value(CASE WHEN r.dur AND r.ty <> 'DELETE' THEN r.ap END IGNORE NULLS) OVER (PARTITION BY r.case_id, r.key ORDER BY r.ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pv FROM rev r),
con AS (SELECT DISTINCT p.case_id, p.key FROM prior p JOIN rl ON rl.case_id = p.case_id AND rl.key = p.key WHERE p.dur AND p.bp IS NOT NULL AND (coalesce(p.pv, CASE WHEN rl.t0 <> 'INSERT' THEN rl.p0 END) <> p.bp OR coalesce(p.kv, CASE WHEN rl.t0 <> 'INSERT' THEN rl.k0 END) <> p.bk)),
rec AS (SELECT coalesce(rl.case_id, p.case_id) AS case_id, coalesce(rl.key, p.key) AS key, coalesce(rl.n_events, 0) AS n_events, coalesce(rl.part, false) AS part, coalesce(p.n, 0) AS cands, coalesce(p.live, 0) AS live, p.so, p.del, p.price, p.broken, coalesce(rl.pd, CASE WHEN rl.t0 <> 'INSERT' THEN rl.p0 END) AS pd, coalesce(rl.psp, CASE WHEN rl.t0 <> 'INSERT' THEN rl.p0 END) AS psp, coalesce(rl.kd, CASE WHEN rl.t0 <> 'INSERT' THEN rl.k0 END) AS kd,
  rl.t0, rl.td, con.key IS NOT NULL AS contra, rl.case_id IS NOT NULL AS logged, EXISTS (SELECT 1 FROM ali WHERE ali.case_id = rl.case_id AND ali.ak = rl.key) AS renamed FROM rl FULL JOIN pick p ON p.case_id = rl.case_id AND p.key = rl.key LEFT JOIN con ON con.case_id = rl.case_id AND con.key = rl.key),
rm AS (SELECT *, CASE WHEN NOT logged THEN CASE WHEN live > 1 THEN 'ambiguous' ELSE 'physical_only' END WHEN cands = 0 THEN 'log_only' WHEN live > 1 THEN 'ambiguous' WHEN renamed THEN 'pk_update_continuity' ELSE 'pk_exact' END AS method, logged AND (case_id = 'B' OR contra) AS gap FROM rec),
oth AS (SELECT case_id, key, bool_or(part = 0 AND ty <> 'DELETE' AND dur) OR bool_or(false) AS full_dur FROM rev GROUP BY case_id, key),
fld0 AS (SELECT r.*, c.col, c.po, coalesce(o.full_dur, false) AS full_dur FROM rm r LEFT JOIN oth o ON o.case_id = r.case_id AND o.key = r.key CROSS JOIN (VALUES ('o_orderkey', 1), ('o_custkey', 2), ('o_orderstatus', 3), ('price_cents', 4), ('o_orderpriority', 5)) c(col, po)),
fld1 AS (SELECT *, CASE WHEN NOT logged THEN false WHEN col IN ('o_orderkey', 'price_cents') THEN pd IS NOT NULL ELSE full_dur OR t0 <> 'INSERT' END AS has_log, so IS NOT NULL AS has_phys, col = 'o_orderstatus' AND coalesce(broken, false) AS undec, gap OR (part AND col IN ('o_custkey', 'o_orderstatus', 'o_orderpriority')) AS lim, CASE WHEN col = 'price_cents' THEN pd = price WHEN col = 'o_orderkey' THEN kd = key ELSE true END AS eq FROM fld0),
fld AS (SELECT *, CASE WHEN undec THEN 'R-RECON-007' WHEN method = 'ambiguous' THEN 'R-RECON-012' WHEN NOT has_log THEN 'R-RECON-005' WHEN NOT has_phys THEN 'R-RECON-006' WHEN eq AND lim THEN 'R-RECON-002' WHEN eq THEN 'R-RECON-001' WHEN lim THEN 'R-RECON-004' ELSE 'R-RECON-003' END AS rule FROM fld1),
pre0 AS (SELECT *, CASE WHEN logged THEN CASE WHEN coalesce(td, CASE WHEN t0 = 'INSERT' THEN 'DELETE' ELSE 'UPDATE' END) = 'DELETE' THEN 'absent' ELSE 'present' END WHEN case_id = 'A' THEN 'absent' ELSE 'unknown' END AS lp, CASE WHEN so IS NULL THEN 'absent' WHEN del THEN 'absent' ELSE 'present' END AS pp FROM rm),
pre AS (SELECT *, CASE WHEN method = 'ambiguous' THEN 'R-RECON-012' WHEN lp = 'unknown' THEN 'R-RECON-006' WHEN lp = pp AND lp = 'absent' AND so IS NOT NULL THEN 'R-RECON-023' WHEN lp = pp THEN 'R-RECON-020' WHEN gap THEN 'R-RECON-022' ELSE 'R-RECON-021' END AS rule FROM pre0),
ver AS (SELECT case_id, key, col, po, rule FROM fld UNION ALL SELECT case_id, key, 'presence', 0, rule FROM pre),
vr AS (SELECT *, CASE WHEN rule = 'R-RECON-007' THEN 'Unsupported' WHEN rule IN ('R-RECON-001', 'R-RECON-020', 'R-RECON-023') THEN 'Exact' WHEN rule = 'R-RECON-002' THEN 'Strong' WHEN rule IN ('R-RECON-003', 'R-RECON-021') THEN 'Conflicting' ELSE 'Unresolved' END AS res FROM ver),
roll AS (SELECT case_id, key, CASE WHEN count(*) FILTER (WHERE res = 'Conflicting') > 0 THEN 'R-ROLL-001' WHEN count(*) FILTER (WHERE res = 'Unresolved') > 0 THEN 'R-ROLL-005' WHEN count(*) FILTER (WHERE res = 'Unsupported') > 0 THEN 'R-ROLL-004' WHEN count(*) FILTER (WHERE res = 'Strong') > 0 THEN 'R-ROLL-003' ELSE 'R-ROLL-002' END AS rule,
  count(*) AS n, count(*) FILTER (WHERE res IN ('Exact', 'Strong', 'Conflicting')) AS compared FROM vr GROUP BY case_id, key),
rolled AS (SELECT *, CASE rule WHEN 'R-ROLL-001' THEN 'Conflicting' WHEN 'R-ROLL-005' THEN 'Unresolved' WHEN 'R-ROLL-004' THEN 'Partial' WHEN 'R-ROLL-003' THEN 'Strong' ELSE 'Exact' END AS res FROM roll)
"""
)


def chain(select: str) -> str:
    return CHAIN + select


_PLACE = "'log.00000' || CAST(f AS VARCHAR) || ':' || CAST(pos AS VARCHAR)"
_EVENT = _PLACE + " || '#' || CAST(ri AS VARCHAR)"
_NAME = "'orders:' || CAST({} AS VARCHAR)"
_KEY = _NAME.format("key")
_GTID = "uuid || ':' || CAST(f * 100000 + t AS VARCHAR)"

#: Every finding of the analysis as (case_id, rule_id, subject, text).
FOUND = f"""
SELECT case_id, 'R-GRP-001' AS rule_id, tx AS subject, tx || ' bounded by GTID ' || {_GTID} AS text FROM mkn WHERE st = 'committed'
UNION ALL SELECT case_id, 'R-GRP-003', tx, tx || ' was rolled back' FROM mkn WHERE st = 'rolled_back'
UNION ALL SELECT m.case_id, CASE WHEN c.n IS NULL THEN 'R-GRP-006' ELSE 'R-GRP-014' END, m.tx, CASE WHEN c.n IS NULL THEN m.tx || ' refers to events that were not decoded' ELSE m.tx || ' is still open where ' || m.file || ' ends, and log.000007 is missing' END
  FROM mkn m LEFT JOIN (SELECT case_id, mh, count(*) AS n FROM cl GROUP BY ALL) c ON c.case_id = m.case_id AND c.mh = m.h WHERE m.st = 'incomplete'
UNION ALL SELECT case_id, 'R-GRP-005', 'TX-SYNTH-00000' || CAST(f AS VARCHAR) || '@' || CAST(s AS VARCHAR), CAST(n AS VARCHAR) || ' event(s) precede the first marker in log.00000' || CAST(f AS VARCHAR) FROM syn
UNION ALL SELECT case_id, 'R-GRP-007', tx, tx || ' belongs to session ' || {_GTID} FROM mkn
UNION ALL SELECT case_id, 'R-GRP-008', tx, tx || ' overlaps ' || CAST(n AS VARCHAR) || ' event(s) with no session identifier' FROM ref
UNION ALL SELECT case_id, 'R-GRP-011', {_EVENT}, 'Event at ' || {_PLACE} || ' belongs to no observed transaction' FROM loose WHERE NOT ldg
UNION ALL SELECT case_id, 'R-GRP-013', {_EVENT}, 'Duplicate row at ' || {_EVENT} FROM ev1 WHERE cp = 1
UNION ALL SELECT case_id, 'R-TXID-001', tx, tx || ' derived from GTID ' || {_GTID} FROM mkn WHERE case_id IN (SELECT case_id FROM mkn GROUP BY case_id HAVING count(DISTINCT uuid) > 1)
UNION ALL SELECT 'B', 'R-COV-002', 'log.000007', 'log.000007 is listed in the index but absent from the evidence set'
UNION ALL SELECT 'B', 'R-COV-005', 'B', 'Acquisition time of the tablespace relative to the last log event is unknown'
UNION ALL SELECT case_id, 'R-CORR-010', {_NAME.format("ak")}, {_NAME.format("ak")} || ' was previously ' || {_NAME.format("bk")} FROM ali
UNION ALL SELECT case_id, 'R-CORR-011', {_KEY}, 'Key continuity for ' || {_KEY} || ' is ambiguous: {SEVERAL_CONTINUATIONS}' FROM amb
UNION ALL SELECT case_id, 'R-CORR-022', {_KEY}, {_KEY} || ' matches ' || CAST(live AS VARCHAR) || ' live physical records' FROM rm WHERE live > 1
UNION ALL SELECT case_id, 'R-CORR-023', {_KEY}, {_KEY} || ' has ' || CAST(cands - live AS VARCHAR) || ' deleted remnant(s) at the same key' FROM rm WHERE live = 1 AND cands > 1
UNION ALL SELECT case_id, 'R-CORR-031', {_KEY}, {_KEY} || ' exists physically with no observed events' FROM rm WHERE NOT logged
UNION ALL SELECT case_id, 'R-HIST-002', {_KEY}, {_KEY} || ': earliest observed state at ' || {_PLACE} FROM (SELECT case_id, key, arg_min(f, ord) AS f, arg_min(pos, ord) AS pos FROM rev GROUP BY ALL)
UNION ALL SELECT case_id, 'R-HIST-007', {_KEY}, {_KEY} || ': o_custkey, o_orderpriority, o_orderstatus not present in the row image' FROM rev WHERE part = 1 AND ty <> 'DELETE' AND dur
UNION ALL SELECT case_id, 'R-HIST-008', {_KEY}, {_KEY} || ': before-image at ' || {_PLACE} || ' differs on ' || columns FROM (
  SELECT p.case_id, p.key, p.ord // 1000000000000 AS f, p.ord % 1000000000000 // 100 AS pos, concat_ws(', ', CASE WHEN coalesce(p.kv, CASE WHEN rl.t0 <> 'INSERT' THEN rl.k0 END) <> p.bk THEN 'o_orderkey' END, CASE WHEN coalesce(p.pv, CASE WHEN rl.t0 <> 'INSERT' THEN rl.p0 END) <> p.bp THEN 'price_cents' END) AS columns
  FROM prior p JOIN rl ON rl.case_id = p.case_id AND rl.key = p.key WHERE p.dur AND p.bp IS NOT NULL) WHERE columns <> ''
UNION ALL SELECT case_id, 'R-HIST-009', {_KEY}, {_KEY} || ': coverage gap after log.000006:' FROM rl WHERE case_id = 'B'
UNION ALL SELECT case_id, 'R-HIST-011', {_NAME.format("ak")}, {_NAME.format("ak")} || ': key changed from ' || {_NAME.format("bk")} || ' at :' FROM ali
"""

# Id, severity and title of each rule, written out here so that reports are not compared with their own table.
TITLES = (
    ("R-PROV-001", "warning", "Provenance is incomplete"),
    ("R-ID-002", "warning", "Key value contains the composite separator"),
    ("R-ID-003", "warning", "Record id namespace collision"),
    ("R-GRP-001", "info", "Transaction bounded by GTID"),
    ("R-GRP-002", "info", "Transaction committed at XID"),
    ("R-GRP-003", "notice", "Transaction rolled back"),
    ("R-GRP-004", "warning", "Terminator missing at the end of the available log"),
    ("R-GRP-005", "warning", "Log begins part-way through a transaction"),
    ("R-GRP-006", "warning", "Marker claimed no events"),
    ("R-GRP-007", "info", "Sessions separated by GTID or thread"),
    ("R-GRP-008", "warning", "Interleaving cannot be resolved"),
    ("R-GRP-009", "warning", "Listed event was not decoded"),
    ("R-GRP-010", "notice", "Event inside range but not listed"),
    ("R-GRP-011", "warning", "Event belongs to no transaction"),
    ("R-GRP-012", "warning", "Duplicate GTID"),
    ("R-GRP-013", "warning", "Duplicate row reference"),
    ("R-GRP-014", "warning", "Terminator falls inside a log file we were not given"),
    ("R-TXID-001", "info", "Transaction id derived from GTID"),
    ("R-COV-001", "warning", "No binlog index available"),
    ("R-COV-002", "warning", "Binlog file missing from the evidence set"),
    ("R-COV-003", "warning", "Log ends mid-transaction"),
    ("R-COV-005", "notice", "Snapshot timing unknown"),
    ("R-CORR-003", "warning", "Key columns absent from the row image"),
    ("R-CORR-010", "notice", "Identity continued across a primary key update"),
    ("R-CORR-011", "warning", "Key continuity is ambiguous"),
    ("R-CORR-012", "notice", "Key reused after deletion"),
    ("R-CORR-020", "warning", "Table has no primary key"),
    ("R-CORR-021", "warning", "Schema not available"),
    ("R-CORR-022", "warning", "Multiple physical candidates"),
    ("R-CORR-023", "notice", "Deleted remnant present alongside a live record"),
    ("R-CORR-030", "warning", "Table not in the evidence scope"),
    ("R-CORR-031", "notice", "Physical record with no log events"),
    ("R-HIST-002", "info", "Earliest state taken from the first observed event"),
    ("R-HIST-007", "warning", "Partial row image"),
    ("R-HIST-008", "warning", "Before-image disagrees with the reconstructed state"),
    ("R-HIST-009", "warning", "Coverage gap inside a record history"),
    ("R-HIST-010", "notice", "Undecodable value propagates"),
    ("R-HIST-011", "notice", "Identity change"),
)
CATALOGUE = "(VALUES " + ", ".join(f"('{i}', '{severity}', '{title}')" for i, severity, title in TITLES) + ") c(id, severity, title)"

#: Every step of every record's history.
STEPS = f"""
SELECT case_id, pk, row_number() OVER (PARTITION BY case_id, pk ORDER BY phase, ord, detail) - 1 AS step, kind, rule_id, detail FROM (
SELECT case_id, CAST(key AS VARCHAR) AS pk, 0 AS phase, 0 AS ord, 'earliest_observed' AS kind, 'R-HIST-002' AS rule_id, {_EVENT} AS detail FROM (SELECT case_id, key, arg_min(f, ord) AS f, arg_min(pos, ord) AS pos, arg_min(ri, ord) AS ri FROM rev GROUP BY ALL)
UNION ALL SELECT case_id, CAST(key AS VARCHAR), 1, ord, 'event', CASE WHEN st IS NULL OR st = 'incomplete' THEN 'R-HIST-006' WHEN st = 'rolled_back' THEN 'R-HIST-005' WHEN ty = 'DELETE' THEN 'R-HIST-004' ELSE 'R-HIST-003' END, {_EVENT} FROM rev
UNION ALL SELECT case_id, CAST(ak AS VARCHAR), 2, 0, 'identity_change', 'R-HIST-011', CAST(bk AS VARCHAR) FROM ali
UNION ALL SELECT case_id, CAST(key AS VARCHAR), 3, 0, 'coverage_gap', 'R-HIST-009', 'log.000007' FROM rl WHERE case_id = 'B'
UNION ALL SELECT case_id, CAST(key AS VARCHAR), 4, 0, 'physical_state', 'R-HIST-012', CAST(so AS VARCHAR) FROM rm WHERE logged AND so IS NOT NULL)
"""
