"""State of each record as the log tells it: no sequential replay, but the last image that carried each column."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import finding
from ..functions.values import compared
from ..sources.tables import settle
from .identity import RECORD, TABLE_KEY, table_keys


def _absent() -> Column:
    return F.expr("cast(map() as map<string,struct<kind:string,text:string>>)")


def first_events(record_images: DataFrame) -> DataFrame:
    """(record, first): its first event by order, committed or not."""
    return record_images.groupBy(*RECORD).agg(F.min_by(F.struct("event_type", "before", "ord"), "ord").alias("first"))


def presence(of_record: DataFrame) -> DataFrame:
    """(record, presence, speculative_presence, seed_presence): of the last committed event, of the last event, and before the first."""
    state = F.when(F.col("event_type") == "DELETE", "absent").otherwise("present")
    last = of_record.groupBy(*RECORD).agg(F.max_by(F.when(F.col("durable"), state), F.when(F.col("durable"), F.col("ord"))).alias("durable_state"), F.max_by(state, "ord").alias("speculative_presence"), F.min_by("event_type", "ord").alias("first_type"))
    seed = F.when(F.col("first_type") == "INSERT", "absent").otherwise("present")
    return last.select(*RECORD, F.coalesce("durable_state", seed).alias("presence"), "speculative_presence", seed.alias("seed_presence"))


def cells(record_images: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row for each event of a record and column that its images carry or its table has: old and new VALUE, seed (what the
    record held before the log: its first event's before image, unless that is an INSERT), prior (the durable VALUE just
    before the event, the seed if none), known (a column of the table), lacks (a known column that an INSERT or UPDATE
    image is without), told (carried by an image).

    Images are dealt out by record once; the columns are taken apart behind that, so what follows by record, or by
    record and column, finds its rows where they are.
    """
    record = Window.partitionBy(*RECORD).orderBy("ord")
    columns = table_keys(catalog).select(*TABLE_KEY, "columns")
    numbered = record_images.withColumn("n_", F.row_number().over(record)).join(columns, TABLE_KEY, "left")
    keys = [F.map_keys(F.coalesce(side, _absent())) for side in ("before", "after")]
    every = F.array_union(F.coalesce("columns", F.expr("cast(array() as array<string>)")), F.array_union(*keys))
    apart = numbered.select(*RECORD, "source_file", "log_position", "row_index", "ord", "event_type", "durable", "tx_id", "n_", "before", "after", "columns", F.explode(every).alias("column"))
    held = {side: F.coalesce(F.map_contains_key(side, F.col("column")), F.lit(False)) for side in ("before", "after")}
    known = F.coalesce(F.array_contains("columns", F.col("column")), F.lit(False))
    lacks = known & (F.col("event_type") != "DELETE") & F.col("after").isNotNull() & ~held["after"]
    rows = apart.withColumns({"old": F.col("before")[F.col("column")], "new": F.col("after")[F.col("column")], "known": known, "lacks": lacks, "told": held["before"] | held["after"]}).drop("before", "after", "columns")
    column = Window.partitionBy(*RECORD, "column").orderBy("ord")
    first = F.first(F.when((F.col("n_") == 1) & (F.col("event_type") != "INSERT"), F.col("old"))).over(column.rowsBetween(Window.unboundedPreceding, 0))
    sets = F.when(F.col("durable") & (F.col("event_type") != "DELETE"), F.col("new"))
    earlier = F.last(sets, True).over(column.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumns({"seed": first, "earlier_": earlier}).withColumn("prior", F.coalesce("earlier_", "seed")).drop("n_", "earlier_")


def contradicting(of_cells: DataFrame) -> DataFrame:
    """of_cells with contradicts, whether a committed before image differs from the state it met (R-HIST-008)."""
    met = F.col("durable") & F.col("old").isNotNull() & F.col("prior").isNotNull() & ~F.col("old").eqNullSafe(F.col("prior"))
    return compared(of_cells, "old", "prior", where=met).withColumn("contradicts", F.coalesce(F.col("c.comparable") & ~F.col("c.equal"), F.lit(False))).drop("c")


def summed(of_cells: DataFrame) -> DataFrame:
    """Per record and column: seed, durable and speculative VALUE, the event that set the durable one, and whether some image
    lacks or contradicts it."""
    carried = (F.col("event_type") != "DELETE") & F.col("new").isNotNull()
    sets = carried & F.col("durable")
    ref = F.struct("source_file", "log_position", "row_index")
    state = F.when(F.col("event_type") == "DELETE", "absent").otherwise("present")
    last = contradicting(of_cells).groupBy(*RECORD, "column").agg(
        F.first("seed").alias("seed"), F.max_by(F.when(sets, F.struct("new", ref.alias("ref"))), F.when(sets, F.col("ord"))).alias("kept"), F.max_by(F.when(carried, F.col("new")), F.when(carried, F.col("ord"))).alias("guess"),
        F.first("known").alias("known"), F.bool_or("told").alias("told"), F.bool_or("lacks").alias("lacks"), F.bool_or("contradicts").alias("contradicted"),
        F.max_by(F.when(F.col("durable"), state), F.when(F.col("durable"), F.col("ord"))).alias("durable_state"), F.min_by("event_type", "ord").alias("first_type"),
    )
    return last.select(*RECORD, "column", "seed", F.coalesce("kept.new", "seed").alias("durable"), F.coalesce("guess", "seed").alias("speculative"), F.col("kept.ref").alias("set_by"), "known", "told", "lacks", "contradicted", F.coalesce("durable_state", F.when(F.col("first_type") == "INSERT", "absent").otherwise("present")).alias("presence"))


def logged_values(of_cells: DataFrame) -> DataFrame:
    """(record, column, new) of every value that an INSERT or UPDATE carried, committed or not."""
    return of_cells.filter("event_type <> 'DELETE' and new is not null").select(*RECORD, "column", "new")


def contradictions(of_cells: DataFrame) -> DataFrame:
    """Committed events whose before image differs from the state they met (R-HIST-008): (record, column, reference)."""
    return contradicting(of_cells).filter("contradicts").select(*RECORD, "column", "source_file", "log_position", "row_index", "old", "prior")


def partial_columns(record_images: DataFrame, catalog: DataFrame) -> DataFrame:
    """(record, partial): schema columns that some INSERT or UPDATE image lacks, committed or not."""
    columns = table_keys(catalog).select(*TABLE_KEY, "columns")
    rows = record_images.filter("event_type <> 'DELETE' and after is not null").join(columns, TABLE_KEY)
    return rows.select(*RECORD, F.explode(F.array_except("columns", F.map_keys("after"))).alias("c")).groupBy(*RECORD).agg(F.array_sort(F.collect_set("c")).alias("partial"))


class History:
    """states: RECORD, column, seed, durable, speculative (VALUEs), set_by. records: RECORD, presence, seed_presence,
    contradicted, partial. cells: the exploded images. presence: records without what needs their images.
    gap_touched of a record: its case has a gap, or its log contradicts itself.

    Nothing is worked out before it is asked for; a filter on the column reaches the images.
    """

    def __init__(self, of_record: DataFrame, record_images: DataFrame, catalog: DataFrame, gaps: DataFrame):
        self._events, self._images, self._catalog, self._gaps = of_record, record_images, catalog, gaps

    @cached_property
    def every_cell(self) -> DataFrame:
        return cells(self._images, self._catalog)

    @cached_property
    def cells(self) -> DataFrame:
        return self.every_cell.filter("told")

    @cached_property
    def summed(self) -> DataFrame:
        return summed(self.every_cell)

    @cached_property
    def states(self) -> DataFrame:
        return self.summed.filter("told").select(*RECORD, "column", "seed", "durable", "speculative", "set_by")

    @cached_property
    def presence(self) -> DataFrame:
        return presence(self._events)

    @cached_property
    def partial(self) -> DataFrame:
        return partial_columns(self._images, self._catalog)

    @cached_property
    def contradicted(self) -> DataFrame:
        return contradictions(self.cells).select(*RECORD).distinct()

    @cached_property
    def gapped(self) -> DataFrame:
        """Cases with a gap."""
        return settle(self._gaps.select("case_id").distinct().withColumn("gap", F.lit(True)))

    @cached_property
    def records(self) -> DataFrame:
        broken = self.contradicted.withColumn("contradicted", F.lit(True))
        rows = self.presence.join(broken, RECORD, "left").join(self.partial, RECORD, "left").join(self.gapped, "case_id", "left")
        return settle(rows.select(*RECORD, "presence", "speculative_presence", "seed_presence", F.coalesce("contradicted", F.lit(False)).alias("contradicted"), F.coalesce("gap", "contradicted", F.lit(False)).alias("gap_touched"), F.coalesce("partial", F.expr("cast(array() as array<string>)")).alias("partial")))


def reconstruct(of_record: DataFrame, record_images: DataFrame, catalog: DataFrame, gaps: DataFrame) -> History:
    """of_record: record events with durable; record_images: the same with their images."""
    return History(of_record, record_images, catalog, gaps)


def steps(of_record: DataFrame) -> DataFrame:
    """History steps: kind, rule and presence before and after each event, in order."""
    state = F.when(F.col("event_type") == "DELETE", "absent").otherwise("present")
    upto = Window.partitionBy(*RECORD).orderBy("ord")
    first = F.first(F.when(F.col("event_type") == "INSERT", "absent").otherwise("present")).over(upto.rowsBetween(Window.unboundedPreceding, 0))
    durable_state = F.when(F.col("durable"), state)
    before = F.coalesce(F.last(durable_state, True).over(upto.rowsBetween(Window.unboundedPreceding, -1)), first)
    kind = F.when(F.col("status").isNull(), "ungrouped").when(F.col("status") == "rolled_back", "rolled_back").when(F.col("status") == "incomplete", "incomplete").when(F.col("event_type") == "DELETE", "delete").otherwise(F.lower("event_type"))
    rule = F.when(F.col("status").isNull() | (F.col("status") == "incomplete"), "R-HIST-006").when(F.col("status") == "rolled_back", "R-HIST-005").when(F.col("event_type") == "DELETE", "R-HIST-004").otherwise("R-HIST-003")
    return of_record.select(*RECORD, "source_file", "log_position", "row_index", "ord", (F.row_number().over(upto) - 1).alias("step"), kind.alias("kind"), rule.alias("rule_id"), before.alias("presence_before"), F.coalesce(durable_state, before).alias("presence_after"))


def field_changes(of_cells: DataFrame) -> DataFrame:
    """Committed changes of a field: (record, column, reference, prior, new); unchanged fields are left out."""
    rows = compared(of_cells.filter("durable and event_type <> 'DELETE' and new is not null"), "prior", "new")
    return rows.filter("not coalesce(c.comparable and c.equal, false)").select(*RECORD, "column", "source_file", "log_position", "row_index", "prior", "new")


def gap_steps(records: DataFrame, gaps: DataFrame) -> DataFrame:
    """One step for each record and each gap of its case."""
    return records.select(*RECORD).join(gaps, "case_id")


def undecodable_images(cells: DataFrame) -> DataFrame:
    """Committed images that hold an undecodable value (R-HIST-010)."""
    return cells.filter("durable and (old.kind = 'undecodable' or new.kind = 'undecodable')").select(*RECORD, "column", "source_file", "log_position", "row_index")


def history_findings(of_record: DataFrame, history: History, catalog: DataFrame, gaps: DataFrame, aliases: DataFrame) -> DataFrame:
    """(case_id, rule_id, subject, context): the earliest state of each record (R-HIST-002), committed images that lack columns (007),
    contradict the state they met (008) or hold undecodable values (010), gaps (009) and earlier keys (011)."""
    name = F.concat("table", F.lit(":"), "pk")
    place = {"source_file": F.col("source_file"), "log_position": F.col("log_position")}
    event = [*RECORD, "source_file", "log_position", "row_index"]
    first = of_record.groupBy(*RECORD).agg(F.min_by(F.struct("source_file", "log_position"), "ord").alias("x")).select(*RECORD, "x.*")
    columns = table_keys(catalog).select(*TABLE_KEY, "columns")
    lacking = of_record.filter("durable and event_type <> 'DELETE' and after is not null").join(columns, TABLE_KEY).withColumn("absent", F.array_sort(F.array_except("columns", F.map_keys("after")))).filter("size(absent) > 0")
    differing = contradictions(history.cells).groupBy(*event).agg(F.array_join(F.array_sort(F.collect_set("column")), ", ").alias("columns"))
    gap = {"source_file": F.col("after_file"), "log_position": F.col("after_position")}
    return (
        finding(first, "R-HIST-002", name, record=name, **place)
        .unionByName(finding(lacking, "R-HIST-007", name, record=name, columns=F.array_join("absent", ", ")))
        .unionByName(finding(differing, "R-HIST-008", name, record=name, columns=F.col("columns"), **place))
        .unionByName(finding(gap_steps(history.presence, gaps), "R-HIST-009", name, record=name, **gap))
        .unionByName(finding(undecodable_images(history.cells), "R-HIST-010", name, record=name, column=F.col("column"), **place))
        .unionByName(finding(aliases.withColumns({"old": F.col("pk"), "pk": F.col("canonical")}), "R-HIST-011", name, record=name, previous_key=F.concat("table", F.lit(":"), "old"), source_file=F.lit(""), log_position=F.lit("")))
    )


#: Order of a record's steps: its earliest state, its events, its earlier keys, the gaps of its case, the row of the snapshot.
PHASES = {"earliest_observed": 0, "event": 1, "identity_change": 2, "coverage_gap": 3, "physical_state": 4}


def all_steps(of_record: DataFrame, records: DataFrame, aliases: DataFrame, gaps: DataFrame) -> DataFrame:
    """(record, step, kind, rule_id, detail): every step of a record's history under a stable index from 0.

    records: the correlated records, with snapshot_ord of the row chosen. detail says which event, key, gap or row.
    """
    logged = of_record.select(*RECORD).distinct()

    def phase(rows: DataFrame, kind: str, rule, detail) -> DataFrame:
        return rows.select(*RECORD, F.lit(PHASES[kind]).alias("phase"), F.col("ord") if "ord" in rows.columns else F.lit(None).cast(of_record.schema["ord"].dataType).alias("ord"), F.lit(kind).alias("kind"), rule.alias("rule_id"), detail.cast("string").alias("detail"))

    place = F.concat_ws("", "source_file", F.lit(":"), F.col("log_position").cast("string"), F.lit("#"), F.col("row_index").cast("string"))
    first = of_record.groupBy(*RECORD).agg(F.min_by(F.struct("source_file", "log_position", "row_index"), "ord").alias("x")).select(*RECORD, "x.*")
    every = (
        phase(first, "earliest_observed", F.lit("R-HIST-002"), place)
        .unionByName(phase(steps(of_record).drop("kind"), "event", F.col("rule_id"), place))
        .unionByName(phase(aliases.withColumns({"old": F.col("pk"), "pk": F.col("canonical")}), "identity_change", F.lit("R-HIST-011"), F.col("old")))
        .unionByName(phase(gap_steps(logged, gaps), "coverage_gap", F.lit("R-HIST-009"), F.coalesce("missing_file", "after_file", F.lit(""))))
        .unionByName(phase(records.filter("snapshot_ord is not null").join(logged, RECORD, "left_semi"), "physical_state", F.lit("R-HIST-012"), F.col("snapshot_ord")))
    )
    order = Window.partitionBy(*RECORD).orderBy("phase", "ord", "detail")
    return every.select(*RECORD, (F.row_number().over(order) - 1).alias("step"), "kind", "rule_id", "detail")
