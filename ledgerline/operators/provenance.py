"""From a value to the event that set it, and from an event to the tool run that decoded it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import finding
from ..functions.values import basename
from .identity import RECORD
from .transactions import REF


def run_of(runs: DataFrame) -> DataFrame:
    """(case_id, file, decoded): for each file its runs that ended well, as an array ordered by where and when they began.

    A file's runs are as many as it was decoded, so the array is short; files meet events by a join that Spark sizes.
    """
    at = F.struct("from_position", "started", "run_id")
    return runs.filter("status = 'ok'").groupBy("case_id", basename(F.col("source_file")).alias("file")).agg(F.array_sort(F.collect_list(at)).alias("decoded"))


def as_of(decoded: Column, position: Column) -> Column:
    """The run that holds for a position: of those that began at it or before, the last by where, then when, they began."""
    return F.try_element_at(F.filter(decoded, lambda r: r["from_position"] <= position), F.lit(-1))["run_id"]


def event_runs(events: DataFrame, runs: DataFrame) -> DataFrame:
    """events with run_id and run_basis: their own run if they carry one (own), else the recorded run of their file as of their
    position (recorded), else null.

    runs: (case_id, run_id, source_file, from_position, started, status); several runs of a file are decodes of its parts, or
    of the whole file again.
    """
    own = F.col("run_id") if "run_id" in events.columns else F.lit(None).cast("string")
    kept = [F.col(f"`{c}`") for c in events.columns if c not in ("run_id", "run_basis")]
    met = events.select(*kept, own.alias("own_"), basename(F.col("source_file")).alias("file")).join(run_of(runs), ["case_id", "file"], "left").withColumn("found_", as_of(F.col("decoded"), F.col("log_position")))
    basis = F.when(F.col("own_").isNotNull(), "own").when(F.col("found_").isNotNull(), "recorded")
    return met.select(*kept, F.coalesce("own_", "found_").alias("run_id"), basis.alias("run_basis"))


def missing_runs(events: DataFrame, runs: DataFrame) -> DataFrame:
    """R-PROV-001: files with an event that no run accounts for, once each."""
    bare = event_runs(events, runs).filter("run_id is null").select("case_id", "source_file").distinct()
    return finding(bare, "R-PROV-001", F.col("source_file"), source_file=F.col("source_file"))


def field_provenance(states: DataFrame, record_events: DataFrame, events: DataFrame, runs: DataFrame) -> DataFrame:
    """(record, column, source_file, log_position, row_index, run_id, basis) of every column with a durable value.

    basis: set_by_event, the last committed event that carried the column; else before_image, as the value was there
    before the log and the record's first event shows it. run_id is null where no run decoded that event.
    """
    ref = F.struct("source_file", "log_position", "row_index")
    first = record_events.groupBy(*RECORD).agg(F.min_by(ref, "ord").alias("first_"))
    valued = states.filter("durable is not null").select(*RECORD, "column", "set_by").join(first, RECORD, "left")
    basis = F.when(F.col("set_by").isNotNull(), "set_by_event").otherwise("before_image")
    placed = valued.select(*RECORD, "column", F.coalesce("set_by", "first_").alias("at_"), basis.alias("basis")).select(*RECORD, "column", "basis", "at_.*")
    decoded = event_runs(events.select(*REF, *(["run_id"] if "run_id" in events.columns else [])), runs).select(*REF, "run_id")
    return placed.join(decoded, REF, "left").select(*RECORD, "column", *REF[1:], "run_id", "basis")
