"""Queries over results: pages, details, groups of flagged records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import key_order, ranked
from . import groups
from .identity import RECORD


def page(ranked: DataFrame, offset: int, limit: int = 100) -> DataFrame:
    """Rows offset to offset + limit - 1 of each case, by their stored ordinal."""
    return ranked.filter(F.col("ordinal").between(offset, offset + min(limit, 100) - 1))


def locate(ranked: DataFrame, size: int = 100) -> DataFrame:
    """First ordinal of the page that each record stands on."""
    return ranked.select("case_id", "pk", (F.floor(F.col("ordinal") / size) * size).cast("long").alias("page"))


def steps_with_events(steps: DataFrame, events: DataFrame) -> DataFrame:
    ref = ["case_id", "source_file", "log_position", "row_index"]
    return steps.join(events.select(*ref, "event_type", "ts"), ref)


def node_kinds(record_verdicts: DataFrame, field_verdicts: DataFrame) -> DataFrame:
    has = lambda name: F.bool_or(F.col("result") == name)
    kind = F.when(has("Conflicting"), "conflicting").when(has("Unresolved"), "unresolved").when(F.bool_and(F.col("result") == "Unsupported"), "unsupported").otherwise("agreeing")
    return field_verdicts.join(record_verdicts.select(*RECORD), RECORD, "left_semi").groupBy(*RECORD).agg(kind.alias("kind"))


def stage_sizes(stages: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.agg(F.lit(name).alias("stage"), F.count("*").alias("n")) for name, df in stages.items()])


def flagged_groups(record_events: DataFrame, flagged: DataFrame) -> DataFrame:
    """(case_id, record, group_id): flagged records joined by shared transactions, each under its group's least pk."""
    touched = record_events.filter("tx_id is not null").select(*RECORD, "tx_id").distinct()
    return groups.members(touched, flagged).withColumn("group_id", F.substring_index("root", groups.SEPARATOR, -1)).drop("root")


def detail(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows that a full key names once; a key that names several is an error, for more of it would be needed."""
    several = rows.groupBy(*keys).agg(F.count("*").alias("n_"))
    checked = rows.join(several, keys).withColumn("one_", F.when(F.col("n_") > 1, F.raise_error(F.lit("ambiguous identity")).cast("boolean")).otherwise(F.lit(True)))
    return checked.filter("one_").drop("n_", "one_")


def fresh(later: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a later stage made from the last run of the stage before it; others are stale."""
    last = runs.groupBy(*keys).agg(F.max("run_id").alias("run_id"))
    return later.join(last, [*keys, "run_id"], "left_semi")


def json_members(df: DataFrame, column: str, schema: str) -> DataFrame:
    """A JSON column's members as columns."""
    return df.withColumn("j_", F.from_json(column, schema)).select("*", "j_.*").drop("j_")


def screen_items(rows: DataFrame, stage: str, kind: str, order: Column | list[Column], identity: Column, bucket: Column, summary: dict[str, Column], **detail: Column) -> DataFrame:
    """(case_id, stage, kind, ordinal, identity, bucket, summary, detail): one item of a screen for each row.

    order: a stored place within the bucket, or what to number the case's rows by. detail: what the full view adds to the summary.
    """
    placed = ranked(rows, order) if isinstance(order, list) else rows.withColumn("ordinal", order)
    as_json = lambda members: F.to_json(F.struct(*[c.alias(n) for n, c in members.items()]), {"ignoreNullFields": "false"})
    return placed.select("case_id", F.lit(stage).alias("stage"), F.lit(kind).alias("kind"), F.col("ordinal").cast("long").alias("ordinal"), identity.cast("string").alias("identity"), bucket.alias("bucket"), as_json(summary).alias("summary"), as_json(summary | detail).alias("detail"))


def screen_index(transactions: DataFrame, steps: DataFrame, field_verdicts: DataFrame, record_verdicts: DataFrame) -> DataFrame:
    """Items of every screen, to be written by case, stage and kind: transactions in replay order, steps of each history,
    compared fields and records in order of their keys."""
    name = F.concat("table", F.lit(":"), "pk")
    by_key = [F.col("database"), F.col("table"), key_order(F.col("pk"))]
    tx = {"id": F.col("tx_id"), "status": F.col("status"), "source_file": F.col("source_file"), "start_position": F.col("start_position"), "event_count": F.col("n_events")}
    step = {"kind": F.col("kind"), "rule_id": F.col("rule_id"), "detail": F.col("detail")}
    field = {"record_id": name, "field": F.col("column"), "result": F.col("result"), "rule_id": F.col("rule_id")}
    record = {"record_id": name, "result": F.col("result"), "rule_id": F.col("rule_id"), "field_count": F.col("fields")}
    items = [
        screen_items(transactions, "grouping", "transactions", [F.col("file_seq"), F.col("start_position")], F.col("tx_id"), F.col("status"), tx, end_position=F.col("end_position"), reason=F.col("reason")),
        screen_items(steps, "reconstruction", "history_steps", F.col("step"), F.col("step"), F.to_json(F.array("table", name)), step),
        screen_items(field_verdicts, "reconciliation", "comparisons", [*by_key, F.col("column")], name, F.col("column"), field, log=F.col("log_display"), physical=F.col("phys_display")),
        screen_items(record_verdicts, "reconciliation", "reconciliation", by_key, name, F.col("result"), record, label=F.col("label")),
    ]
    return reduce(DataFrame.unionByName, items)


def graph_items(records: DataFrame, edges: DataFrame, steps: DataFrame, tx_events: DataFrame, findings: DataFrame) -> DataFrame:
    """Items that screens ask for when something is opened: records and edges of the graph, histories, the events of each
    transaction, and findings that are more than information.

    findings: described and distinct. An event's place is the one stored with its transaction; edges are numbered by
    transaction, record and type, histories and records by key, findings by rule, subject and text.
    """
    name = F.concat("table", F.lit(":"), "pk")
    by_key = [F.col("database"), F.col("table"), key_order(F.col("pk"))]
    none = F.lit("")
    method = {"record": name, "method": F.col("method")}
    counts = steps.groupBy(*RECORD).agg(F.count("*").alias("steps_"))
    told = records.join(counts, RECORD)
    edge = {"tx_id": F.col("tx_id"), "record_id": name, "event_type": F.col("event_type")}
    place = {"source_file": F.col("source_file"), "log_position": F.col("log_position"), "row_index": F.col("row_index")}
    said = {"rule_id": F.col("rule_id"), "severity": F.col("severity"), "subject": F.col("subject"), "text": F.col("text")}
    whole = F.to_json(F.struct(*[c.alias(n) for n, c in said.items()]), {"ignoreNullFields": "false"})
    items = [
        screen_items(records, "correlation", "graph_records", by_key, name, none, method, candidates=F.col("candidates"), live=F.col("live")),
        screen_items(edges, "correlation", "graph_edges", [F.col("tx_id"), *by_key, F.col("event_type")], name, F.col("tx_id"), edge),
        screen_items(told, "reconstruction", "histories", by_key, name, F.col("table"), method | {"step_count": F.col("steps_")}, candidates=F.col("candidates")),
        screen_items(tx_events, "grouping", "events", F.col("event_order"), F.col("event_order"), F.col("tx_id"), place, event_type=F.col("event_type"), durable=F.col("durable")),
        screen_items(findings.filter("severity <> 'info'"), "all", "findings", [F.col("rule_id"), F.col("subject"), F.col("text")], F.sha2(whole, 256), F.to_json(F.array("rule_id", "severity")), said),
    ]
    return reduce(DataFrame.unionByName, items)
