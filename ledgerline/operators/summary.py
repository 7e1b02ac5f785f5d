"""Groups of a report: what is exceptional, how often, where it was seen, and the totals it stands against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import described, distinct_findings
from ..functions.values import canonical_map
from .identity import RECORD, TABLE_KEY
from .reconcile import COUNTS

GROUP = ["case_id", "kind", "table", "field", "result", "rule_id", "severity", "evidence"]
OBSERVED = [*GROUP, "identity", "record", "context", "source_file", "log_position", "row_index"]
#: Rules that are told in a report even where they are only information.
TOLD = ("R-COV-", "R-PROV-")


def _name() -> Column:
    return F.concat("table", F.lit(":"), "pk")


def field_observations(field_verdicts: DataFrame, states: DataFrame, explanations: DataFrame) -> DataFrame:
    """One row for each field that is not Exact: the sides it was seen on, what explains it, and the event that set its value."""
    seen = lambda c, side: F.when(F.col(c) != "not observed", F.lit(side))
    sides = F.concat_ws(" + ", seen("log_display", "log"), seen("phys_display", "snapshot"))
    set_by = states.select(*RECORD, "column", "set_by")
    why = explanations.select(*RECORD, "column", F.col("rule_id").alias("context"))
    rows = field_verdicts.filter("result <> 'Exact'").join(set_by, [*RECORD, "column"], "left").join(why, [*RECORD, "column"], "left")
    return rows.select(
        "case_id", F.lit("record").alias("kind"), F.concat_ws(".", "database", "table").alias("table"), F.col("column").alias("field"), "result", "rule_id", F.lit("warning").alias("severity"),
        F.when(sides == "", "Unknown").otherwise(sides).alias("evidence"), F.concat_ws("|", F.concat_ws(".", "database", "table"), "pk", "column").alias("identity"), F.concat_ws(":", F.concat_ws(".", "database", "table"), "pk").alias("record"),
        F.coalesce("context", F.lit("")).alias("context"), F.coalesce("set_by.source_file", F.lit("Unknown")).alias("source_file"), F.col("set_by.log_position").alias("log_position"), F.col("set_by.row_index").cast("long").alias("row_index"),
    )


def finding_observations(findings: DataFrame) -> DataFrame:
    """One row for each distinct finding that is more than information: its table by its context, and the place it names."""
    told = F.exists(F.array(*[F.lit(x) for x in TOLD]), lambda x: F.startswith("rule_id", x))
    rows = described(distinct_findings(findings)).filter((F.col("severity") != "info") | told)
    held = lambda key: F.when(F.col("context")[key] != "", F.col("context")[key])
    table = F.coalesce(held("table"), F.substring_index(held("record"), ":", 1), F.lit("Case / unknown table"))
    said = canonical_map(F.col("context"))
    return rows.select(
        "case_id", F.lit("warning").alias("kind"), table.alias("table"), F.lit("").alias("field"), F.lit("").alias("result"), "rule_id", "severity", F.when(held("source_file").isNotNull(), "log").otherwise("Unknown").alias("evidence"),
        F.concat_ws("|", "rule_id", "subject", said).alias("identity"), held("record").alias("record"), said.alias("context"), F.coalesce(held("source_file"), F.lit("Unknown")).alias("source_file"), held("log_position").cast("long").alias("log_position"), held("row_index").cast("long").alias("row_index"),
    )


def observations(field_verdicts: DataFrame, states: DataFrame, explanations: DataFrame, findings: DataFrame) -> DataFrame:
    return field_observations(field_verdicts, states, explanations).unionByName(finding_observations(findings)).select(*OBSERVED)


def exception_groups(observed: DataFrame) -> DataFrame:
    """Groups by (kind, table, field, result, rule, severity, evidence): occurrences, records, contexts and source files, each counted once.

    An observation with several rows, one for each place, is one occurrence. Spark counts the four kinds in one pass, first
    within tasks and then by the value counted, so a group that holds a third of all rows is no hot key.
    """
    count = lambda c, name: F.countDistinct(c).alias(name)
    return observed.groupBy(*GROUP).agg(count("identity", "occurrences"), count("record", "records"), count("context", "contexts"), count("source_file", "sources"))


def source_ranges(observed: DataFrame) -> DataFrame:
    """Where each group was seen, by source file: distinct places with the first and the last, and observations without one."""
    place = F.when(F.col("log_position").isNotNull(), F.struct("log_position", F.coalesce("row_index", F.lit(-1))))
    lost = F.when(F.col("log_position").isNull(), F.col("identity"))
    return observed.groupBy(*GROUP, "source_file").agg(F.countDistinct(place).alias("located"), F.min("log_position").alias("first_position"), F.max("log_position").alias("last_position"), F.countDistinct(lost).alias("unknown"))


def totals(records: DataFrame) -> DataFrame:
    """(case_id, table, granularity, result, n): records and fields by verdict, zero where there is none, for every table and, with
    table null, for the case. records: one verdict each with the counts of its fields (reconcile.COUNTS), so one pass counts both."""
    sums = [x for c, name in COUNTS.items() for x in (F.count_if(F.col("result") == name).alias(f"records_{c}"), F.sum(c).alias(f"fields_{c}"))]
    by_table = records.groupBy("case_id", F.concat_ws(".", "database", "table").alias("table")).agg(*sums)
    said = [F.struct(F.lit(g).alias("granularity"), F.lit(name).alias("result"), F.col(f"{g}_{c}").alias("n")) for g in ("records", "fields") for c, name in COUNTS.items()]
    shown = F.explode(F.array(F.col("table"), F.lit(None).cast("string")))
    rows = by_table.select("case_id", shown.alias("shown"), F.array(*said).alias("said")).select("case_id", "shown", F.explode("said").alias("x"))
    return rows.groupBy("case_id", F.col("shown").alias("table"), "x.granularity", "x.result").agg(F.sum("x.n").alias("n"))


def input_counts(snapshot: DataFrame, events: DataFrame, catalog: DataFrame) -> DataFrame:
    """(case_id, section, table, category, n): snapshot rows live and deleted, events by type, columns of each known table."""
    table = F.concat_ws(".", "database", "table").alias("table")
    part = lambda df, section, category: df.groupBy("case_id", F.lit(section).alias("section"), table, category.alias("category")).agg(F.count("*").alias("n"))
    state = F.when(F.col("is_deleted"), "deleted").otherwise("live")
    return part(snapshot, "snapshot", state).unionByName(part(events, "events", F.col("event_type"))).unionByName(part(catalog.select(*TABLE_KEY, "column"), "schemas", F.lit("columns")))
