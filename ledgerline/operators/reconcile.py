"""Replayed state against snapshot, field by field: six verdicts, each with the rule that gave it."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import VALUE, compare, compared, is_supported, render
from ..sources.tables import settle
from . import identity
from .history import History
from .identity import RECORD, TABLE_KEY, Correlation

# Verdicts from the least to the most severe.
SEVERITY = ("Exact", "Strong", "Partial", "Unsupported", "Unresolved", "Conflicting")
COMPARED = ("Exact", "Strong", "Conflicting")
#: Counts of a record's fields by verdict.
COUNTS = {f"n_{name.lower()}": name for name in SEVERITY}


def severity(result: Column) -> Column:
    out = F.lit(0)
    for n, name in enumerate(SEVERITY):
        out = F.when(result == name, n).otherwise(out)
    return out


def grid(correlation: Correlation, history: History, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(of the log, of the snapshot alone): every record by every column of its table, with the log's and the snapshot's VALUE
    (null: not observed); the first column of a record is marked as such.

    What the log says lies by record already, so the snapshot's rows come to it; other records have no column of the log.
    """
    ahead = Window.partitionBy(*TABLE_KEY)
    columns = catalog.select(*TABLE_KEY, "column", "position", "data_type").withColumn("first", F.struct("position", "column") == F.min(F.struct("position", "column")).over(ahead))
    widths = identity.widths(catalog)
    touched = F.bool_or("contradicted").over(Window.partitionBy(*RECORD))
    logged = history.summed.withColumn("touched_", touched).filter("known").select(*RECORD, "column", F.col("durable").alias("log"), "speculative", "lacks", "touched_", "presence")
    met = logged.join(correlation.rows, RECORD, "left").join(identity.by_continuity(correlation.aliases), RECORD, "left").withColumn("n_events", F.lit(1))
    of_log = met.join(history.gapped, "case_id", "left").join(columns, [*TABLE_KEY, "column"]).withColumn("gap_touched", F.coalesce("gap", "touched_")).withColumn("limited", F.col("gap_touched") | F.col("lacks"))
    bare = correlation.rows.join(correlation.record_events.select(*RECORD), RECORD, "left_anti").join(columns, TABLE_KEY)
    none = F.lit(None).cast(VALUE)
    alone = bare.withColumns({"log": none, "speculative": none, "presence": F.lit(None).cast("string"), "gap_touched": F.lit(False), "limited": F.lit(False), "previous": F.expr("cast(null as array<string>)"), "n_events": F.lit(0)})
    shown = [*RECORD, "column", "position", "data_type", "first", "log", "speculative", F.col("values")[F.col("column")].alias("phys"), "presence", "gap_touched", "limited", "method", "snapshot_ord", "is_deleted", "n_events"]
    return tuple(df.join(widths, TABLE_KEY, "left").withColumn("method", identity.method()).select(*shown) for df in (of_log, alone))


def judge(cells: DataFrame) -> DataFrame:
    """cells with result and rule_id: the first rung of the ladder that applies."""

    def verdict(result: str, rule: str) -> Column:
        return F.struct(F.lit(result).alias("result"), F.lit(rule).alias("rule_id"))

    c = F.col("c")
    kinds = [F.coalesce(F.col(f"{side}.kind"), F.lit("")) for side in ("log", "phys")]
    rung = (
        F.when(~is_supported(F.col("data_type")), verdict("Unsupported", "R-RECON-008"))
        .when((kinds[0] == "undecodable") | (kinds[1] == "undecodable"), verdict("Unsupported", "R-RECON-007"))
        .when(F.col("method") == "ambiguous", verdict("Unresolved", "R-RECON-012"))
        .when(F.coalesce("health", F.lit("valid")) != "valid", verdict("Unresolved", "R-RECON-009"))
        .when(F.col("log").isNull(), verdict("Unresolved", "R-RECON-005"))
        .when(F.col("phys").isNull(), verdict("Unresolved", "R-RECON-006"))
        .when(~c["comparable"], verdict("Unsupported", "R-RECON-010"))
        .when(c["equal"] & F.col("limited"), verdict("Strong", "R-RECON-002"))
        .when(c["equal"] & (kinds[0] == "null") & (kinds[1] == "null"), verdict("Exact", "R-RECON-011"))
        .when(c["equal"], verdict("Exact", "R-RECON-001"))
        .when(F.col("limited"), verdict("Unresolved", "R-RECON-004"))
        .otherwise(verdict("Conflicting", "R-RECON-003"))
    )
    return compared(cells, "log", "phys", "data_type").withColumn("v_", rung).select("*", "v_.result", "v_.rule_id").drop("v_", "c")


def explain_conflicts(conflicts: DataFrame, record_images: DataFrame) -> DataFrame:
    """Conflicts that equal a value never committed (R-RECON-030) or no value ever logged (R-RECON-031).

    Only conflicts meet the values logged, one at a time: a field's values are never gathered, and images of other records are
    not taken apart.
    """
    place = [*RECORD, "column"]
    guess = compare(F.col("speculative"), F.col("phys"), F.col("data_type"))
    asked = settle(conflicts.select(*place, "phys", "data_type", F.coalesce(guess["comparable"] & guess["equal"], F.lit(False)).alias("guessed")))
    images = record_images.filter("event_type <> 'DELETE' and after is not null").join(asked.select(*RECORD).distinct(), RECORD, "left_semi")
    logged = images.select(*RECORD, F.explode("after").alias("column", "new")).filter("new is not null")
    met = compared(asked.join(logged, place, "left"), "new", "phys", "data_type")
    told = met.groupBy(*place).agg(F.bool_or("guessed").alias("guessed"), F.count("new").alias("logged"), F.bool_or(F.coalesce(F.col("c.equal"), F.lit(False))).alias("known"))
    rule = F.when(F.col("guessed"), "R-RECON-030").when((F.col("logged") > 0) & ~F.col("known"), "R-RECON-031")
    return told.withColumn("rule_id", rule).filter("rule_id is not null").select(*place, "rule_id")


def judge_presence(rows: DataFrame) -> DataFrame:
    """rows with asked, whether their record exists, as a field of its own: that is asked before what the record holds."""
    sound = (F.coalesce("health", F.lit("")) == "valid") & F.coalesce("extracted", F.lit(False))
    logged = F.coalesce("presence", F.when((F.col("n_events") == 0) & sound & F.coalesce("created", F.lit(False)), "absent"), F.lit("unknown"))
    shown = F.when(F.col("snapshot_ord").isNull(), F.when(sound, "absent").otherwise("unknown")).when(F.col("is_deleted"), "absent").otherwise("present")
    rows = rows.withColumns({"log_presence": logged, "phys_presence": shown})
    same = F.col("log_presence") == F.col("phys_presence")
    rule = (
        F.when(F.col("health").isNotNull() & (F.col("health") != "valid"), "R-RECON-009")
        .when(F.col("method") == "ambiguous", "R-RECON-012")
        .when((F.col("log_presence") == "unknown") | (F.col("phys_presence") == "unknown"), "R-RECON-006")
        .when(same & (F.col("log_presence") == "absent") & F.col("snapshot_ord").isNotNull(), "R-RECON-023")
        .when(same, "R-RECON-020")
        .when(F.coalesce("gap_touched", F.lit(False)), "R-RECON-022")
        .otherwise("R-RECON-021")
    )
    rows = rows.withColumn("presence_rule", rule)
    result = F.when(F.col("presence_rule").isin("R-RECON-023", "R-RECON-020"), "Exact").when(F.col("presence_rule") == "R-RECON-021", "Conflicting").otherwise("Unresolved")
    return rows.withColumn("asked", F.struct(F.lit("presence").alias("column"), F.lit(0).alias("position"), F.col("log_presence").alias("log_display"), F.col("phys_presence").alias("phys_display"), result.alias("result"), F.col("presence_rule").alias("rule_id")))


def unsupported_tables(gate: DataFrame) -> DataFrame:
    """One table-level row for each table that cannot be correlated."""
    return gate.select(*TABLE_KEY, F.lit("").alias("pk"), F.lit("table").alias("column"), F.lit(0).alias("position"), F.lit("not observed").alias("log_display"), F.lit("not observed").alias("phys_display"), F.lit("Unsupported").alias("result"), "rule_id")


def roll_up(field_verdicts: DataFrame) -> DataFrame:
    """One verdict per record, worst news first, with label and triggers."""
    has = lambda name: F.bool_or(F.col("result") == name)
    n = F.count("*")
    compared = F.count_if(F.col("result").isin(*COMPARED))
    rule = (
        F.when(F.bool_and(F.col("result") == "Unsupported"), "R-ROLL-006").when(has("Conflicting"), "R-ROLL-001").when(has("Unresolved") | (compared == 0), "R-ROLL-005")
        .when(has("Unsupported"), "R-ROLL-004").when(has("Strong"), "R-ROLL-003").otherwise("R-ROLL-002")
    )
    grouped = field_verdicts.withColumn("sev_", severity(F.col("result"))).groupBy(*RECORD).agg(
        rule.alias("rule_id"), n.alias("fields"), compared.alias("compared"), F.max("sev_").alias("worst_"), *[F.count_if(F.col("result") == name).alias(c) for c, name in COUNTS.items()],
        F.array_sort(F.collect_list(F.struct("sev_", "position", "column", "result"))).alias("all_"),
    )
    names = dict(zip(("R-ROLL-006", "R-ROLL-001", "R-ROLL-005", "R-ROLL-004", "R-ROLL-003", "R-ROLL-002"), ("Unsupported", "Conflicting", "Unresolved", "Partial", "Strong", "Exact"), strict=True))
    rollup = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("rule_id"))
    at_worst = F.filter("all_", lambda s: s["sev_"] == F.col("worst_"))
    worst = F.element_at(F.array(*[F.lit(s) for s in SEVERITY]), F.col("worst_") + 1)
    label = F.when(F.size(at_worst) == 1, F.concat(F.element_at(at_worst, 1)["column"], F.lit(": "), worst)).otherwise(F.concat(F.size(at_worst).cast("string"), F.lit(" fields: "), worst))
    triggers = F.transform(F.array_sort(F.transform(F.filter("all_", lambda s: s["result"].isin("Conflicting", "Unresolved")), lambda s: F.struct(s["position"].alias("position"), s["column"].alias("column"), s["result"].alias("result")))), lambda s: F.concat(s["column"], F.lit(": "), s["result"]))
    return grouped.select(*RECORD, rollup.alias("result"), "rule_id", label.alias("label"), "fields", "compared", triggers.alias("triggers"), (F.size(triggers) > 0).alias("flagged"), *COUNTS)


class Reconciliation:
    """fields: a verdict for each field and for the presence of each record; records: one for each record, with counts of its fields by
    verdict; both without a shuffle of their own, as the grid lies by record. field_verdicts, record_verdicts: the same, written.
    explanations of conflicts."""

    def __init__(self, correlation: Correlation, history: History, catalog: DataFrame, health: DataFrame, extractions: DataFrame, creations: DataFrame, coverage: DataFrame):
        self._correlation, self._history, self._catalog, self._health, self._extractions, self._creations, self._coverage = correlation, history, catalog, health, extractions, creations, coverage

    @cached_property
    def grid(self) -> tuple[DataFrame, DataFrame]:
        return grid(self._correlation, self._history, self._catalog)

    @cached_property
    def _judged(self) -> list[DataFrame]:
        complete = self._coverage.filter("complete").select("case_id")
        created = settle(self._creations.select(*TABLE_KEY).distinct().join(complete, "case_id", "left_semi").join(self._correlation.uncertain, TABLE_KEY, "left_anti").withColumn("created", F.lit(True)))
        health = self._health.select(*TABLE_KEY, F.col("status").alias("health"))
        extracted = self._extractions.select(*TABLE_KEY).distinct().withColumn("extracted", F.lit(True))
        sound = lambda df: df.join(health, TABLE_KEY, "left").join(extracted, TABLE_KEY, "left").join(created, TABLE_KEY, "left")
        return [judge_presence(judge(sound(df))) for df in self.grid]

    @cached_property
    def _parts(self) -> list[DataFrame]:
        field = F.struct("column", F.col("position").cast("int").alias("position"), render(F.col("log")).alias("log_display"), render(F.col("phys")).alias("phys_display"), "result", "rule_id")
        parts = [df.select(*RECORD, F.explode(F.when(F.col("first"), F.array(field, F.col("asked"))).otherwise(F.array(field))).alias("x")).select(*RECORD, "x.*") for df in self._judged]
        return [*parts, unsupported_tables(self._correlation.unsupported)]

    @cached_property
    def presence(self) -> DataFrame:
        """The fields that say whether a record exists."""
        return reduce(DataFrame.unionByName, [df.filter("first").select(*RECORD, "asked.*") for df in self._judged])

    @cached_property
    def fields(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self._parts)

    @cached_property
    def records(self) -> DataFrame:
        return reduce(DataFrame.unionByName, map(roll_up, self._parts))

    @cached_property
    def field_verdicts(self) -> DataFrame:
        return settle(self.fields)

    @cached_property
    def record_verdicts(self) -> DataFrame:
        return settle(self.records.drop(*COUNTS))

    @cached_property
    def explanations(self) -> DataFrame:
        conflicts = reduce(DataFrame.unionByName, [df.filter("result = 'Conflicting'").select(*RECORD, "column", "phys", "data_type", "speculative") for df in self._judged])
        return explain_conflicts(conflicts, self._correlation.record_images)


def reconcile(correlation: Correlation, history: History, catalog: DataFrame, health: DataFrame, extractions: DataFrame, creations: DataFrame, coverage: DataFrame) -> Reconciliation:
    return Reconciliation(correlation, history, catalog, health, extractions, creations, coverage)
