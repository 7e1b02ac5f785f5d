"""What of a case goes into an export: a closure over references, with the reason for each row that is kept."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .identity import RECORD
from .transactions import REF

SECTIONS = ("records", "fields", "transactions", "events", "snapshot_rows")


@dataclass(frozen=True)
class Selection:
    """Each frame has its rows' keys, status (included, summarised, excluded) and reason (null unless included)."""

    records: DataFrame
    fields: DataFrame
    transactions: DataFrame
    events: DataFrame
    snapshot_rows: DataFrame


def _told(rows: DataFrame, keys: list[str], reason: Column, asked: bool) -> DataFrame:
    status = F.when(F.lit(not asked), "excluded").when(reason.isNotNull(), "included").otherwise("summarised")
    return rows.select(*keys, status.alias("status"), F.when(F.lit(asked), reason).alias("reason"))


def select(record_verdicts: DataFrame, field_verdicts: DataFrame, record_events: DataFrame, transactions: DataFrame, tx_events: DataFrame, events: DataFrame, keyed_snapshot: DataFrame, everything: bool = False, sections: Iterable[str] = SECTIONS) -> Selection:
    """Choose by verdict and follow references: a record with a field that is not Exact (or every record); of its fields
    those; transactions that touched it or did not commit; events of the record, of those transactions, or of none; and
    every snapshot row under the record's key.

    What an asked section leaves out is summarised, what no one asked for is excluded; both are counted only. The
    first reason that holds is given. Each step is a semi join on keys, so nothing is gathered anywhere.
    """
    asked = set(sections)
    mark = lambda df, keys, name: df.select(*keys).distinct().withColumn(name, F.lit(True))
    differs = F.lit(True) if everything else F.col("result") != "Exact"
    chosen = mark(field_verdicts.filter(differs), RECORD, "chosen")
    why = F.when(F.lit(everything), "all").otherwise("not_exact")
    records = _told(record_verdicts.select(*RECORD).join(chosen, RECORD, "left"), RECORD, F.when(F.col("chosen"), why), "records" in asked)
    fields = _told(field_verdicts, [*RECORD, "column"], F.when(differs, why), "fields" in asked)
    touched = mark(record_events.filter("tx_id is not null").join(chosen, RECORD, "left_semi"), ["case_id", "tx_id"], "touches")
    of_tx = transactions.select("case_id", "tx_id", "status").join(touched, ["case_id", "tx_id"], "left")
    tx_reason = F.when(F.col("touches"), "touches_selected_record").when(F.col("status") != "committed", "not_committed")
    told_tx = of_tx.select("case_id", "tx_id", tx_reason.alias("why"))
    own = mark(record_events.join(chosen, RECORD, "left_semi"), REF, "own")
    with_tx = tx_events.select(*REF, "tx_id").join(told_tx, ["case_id", "tx_id"])
    grouped = with_tx.groupBy(*REF).agg(F.bool_or(F.col("why").isNotNull()).alias("by_tx"))
    seen = events.select(*REF).join(own, REF, "left").join(grouped, REF, "left")
    event_reason = F.when(F.col("own"), "of_selected_record").when(F.col("by_tx"), "of_selected_transaction").when(F.col("by_tx").isNull(), "ungrouped")
    rows = keyed_snapshot.select(*RECORD, "snapshot_ord").join(chosen, RECORD, "left")
    return Selection(
        records, fields, _told(told_tx, ["case_id", "tx_id"], F.col("why"), "transactions" in asked), _told(seen, REF, event_reason, "events" in asked),
        _told(rows, [*RECORD, "snapshot_ord"], F.when(F.col("chosen"), "key_of_selected_record"), "snapshot_rows" in asked),
    )


def counts(selection: Selection) -> DataFrame:
    """(case_id, section, status, reason, n)."""
    part = lambda name: getattr(selection, name).groupBy("case_id", F.lit(name).alias("section"), "status", "reason").agg(F.count("*").alias("n"))
    return reduce(DataFrame.unionByName, [part(name) for name in SECTIONS])
