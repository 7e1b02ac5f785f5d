"""The rule catalogue: how severe each finding is, what it is called and how it reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .values import canonical_map, rule_text

# Id, severity, title and text of each rule that findings name.
RULES = (
    ("R-PROV-001", "warning", "Provenance is incomplete", "No tool run recorded for {source_file}"),
    ("R-ID-002", "warning", "Key value contains the composite separator", "{record}: key value contains {separator}"),
    ("R-ID-003", "warning", "Record id namespace collision", "Table {table} exists in more than one database: {databases}"),
    ("R-GRP-001", "info", "Transaction bounded by GTID", "{transaction} bounded by GTID {gtid}"),
    ("R-GRP-002", "info", "Transaction committed at XID", "{transaction} committed at XID {xid}"),
    ("R-GRP-003", "notice", "Transaction rolled back", "{transaction} was rolled back"),
    ("R-GRP-004", "warning", "Terminator missing at the end of the available log", "{transaction} is still open where {source_file} ends"),
    ("R-GRP-005", "warning", "Log begins part-way through a transaction", "{count} event(s) precede the first marker in {source_file}"),
    ("R-GRP-006", "warning", "Marker claimed no events", "{transaction} refers to events that were not decoded"),
    ("R-GRP-007", "info", "Sessions separated by GTID or thread", "{transaction} belongs to session {session_key}"),
    ("R-GRP-008", "warning", "Interleaving cannot be resolved", "{transaction} overlaps {count} event(s) with no session identifier"),
    ("R-GRP-009", "warning", "Listed event was not decoded", "{transaction} lists position {log_position} in {source_file}, not decoded"),
    ("R-GRP-010", "notice", "Event inside range but not listed", "Event at {source_file}:{log_position} lies inside {transaction} but is not listed"),
    ("R-GRP-011", "warning", "Event belongs to no transaction", "Event at {source_file}:{log_position} belongs to no observed transaction"),
    ("R-GRP-012", "warning", "Duplicate GTID", "GTID {gtid} appears in {count} transactions"),
    ("R-GRP-013", "warning", "Duplicate row reference", "Duplicate row at {source_file}:{log_position}#{row_index}"),
    ("R-GRP-014", "warning", "Terminator falls inside a log file we were not given", "{transaction} is still open where {source_file} ends, and {missing_files} is missing"),
    ("R-TXID-001", "info", "Transaction id derived from GTID", "{transaction} derived from GTID {gtid}"),
    ("R-COV-001", "warning", "No binlog index available", "No binlog index in the evidence set; log ordering falls back to file names"),
    ("R-COV-002", "warning", "Binlog file missing from the evidence set", "{source_file} is listed in the index but absent from the evidence set"),
    ("R-COV-003", "warning", "Log ends mid-transaction", "{source_file} ends with {transaction} still open"),
    ("R-COV-005", "notice", "Snapshot timing unknown", "Acquisition time of the tablespace relative to the last log event is unknown"),
    ("R-CORR-003", "warning", "Key columns absent from the row image", "Event at {source_file}:{log_position} has no usable key: {reason}"),
    ("R-CORR-010", "notice", "Identity continued across a primary key update", "{record} was previously {previous_key}"),
    ("R-CORR-011", "warning", "Key continuity is ambiguous", "Key continuity for {key} is ambiguous: {reason}"),
    ("R-CORR-012", "notice", "Key reused after deletion", "{record} was deleted and later re-inserted"),
    ("R-CORR-020", "warning", "Table has no primary key", "{table} has no primary key; its events cannot be correlated"),
    ("R-CORR-021", "warning", "Schema not available", "No schema available for {table}"),
    ("R-CORR-022", "warning", "Multiple physical candidates", "{record} matches {count} live physical records"),
    ("R-CORR-023", "notice", "Deleted remnant present alongside a live record", "{record} has {count} deleted remnant(s) at the same key"),
    ("R-CORR-030", "warning", "Table not in the evidence scope", "No tablespace in the evidence set for {table}"),
    ("R-CORR-031", "notice", "Physical record with no log events", "{record} exists physically with no observed events"),
    ("R-HIST-002", "info", "Earliest state taken from the first observed event", "{record}: earliest observed state at {source_file}:{log_position}"),
    ("R-HIST-007", "warning", "Partial row image", "{record}: {columns} not present in the row image"),
    ("R-HIST-008", "warning", "Before-image disagrees with the reconstructed state", "{record}: before-image at {source_file}:{log_position} differs on {columns}"),
    ("R-HIST-009", "warning", "Coverage gap inside a record history", "{record}: coverage gap after {source_file}:{log_position}"),
    ("R-HIST-010", "notice", "Undecodable value propagates", "{record}: {column} became undecodable at {source_file}:{log_position}"),
    ("R-HIST-011", "notice", "Identity change", "{record}: key changed from {previous_key} at {source_file}:{log_position}"),
)

# Fixed value: why continuity of a key is not determined.
SEVERAL_CONTINUATIONS = "more than one continuation is consistent with the evidence"


def finding(rows: DataFrame, rule: str | Column, subject: Column, **context: Column) -> DataFrame:
    """(case_id, rule_id, subject, context): one finding for each row; context holds what the rule's text names, null as empty text."""
    pairs = [x for name, c in sorted(context.items()) for x in (F.lit(name), F.coalesce(c.cast("string"), F.lit("")))]
    said = F.create_map(*pairs) if pairs else F.expr("cast(map() as map<string,string>)")
    return rows.select("case_id", (F.lit(rule) if isinstance(rule, str) else rule).alias("rule_id"), subject.alias("subject"), said.alias("context"))


def described(findings: DataFrame) -> DataFrame:
    """findings with severity, title and text; a rule that the catalogue lacks is an error. The catalogue has a fixed length."""
    rules = findings.sparkSession.createDataFrame(RULES, "rule_id string, severity string, title string, template string")
    joined = findings.join(F.broadcast(rules), "rule_id", "left")
    known = F.when(F.col("title").isNull(), F.raise_error(F.concat(F.lit("unknown rule "), "rule_id")).cast("string")).otherwise(F.col("title"))
    return joined.withColumn("title", known).withColumn("text", rule_text(F.col("template"), F.col("context"))).drop("template")


def distinct_findings(findings: DataFrame) -> DataFrame:
    """One of each (case, rule, subject, context)."""
    return findings.withColumn("said_", canonical_map(F.col("context"))).dropDuplicates(["case_id", "rule_id", "subject", "said_"]).drop("said_")
