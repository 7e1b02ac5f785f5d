"""Record identity: keys of events and snapshot rows, key changes followed where the evidence determines them."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import SEVERAL_CONTINUATIONS, finding
from ..functions.values import basename, record_pk, render_key, separator_collides
from ..sources.tables import settle
from .transactions import REF, Grouping, transaction_of

TABLE_KEY = ["case_id", "database", "table"]
RECORD = [*TABLE_KEY, "pk"]


def table_keys(catalog: DataFrame) -> DataFrame:
    """(table, pk_columns, columns): key columns and all columns in order; pk_columns is empty for a table without key."""
    by = F.struct("position", F.col("column"))
    names = lambda rows: F.transform(F.array_sort(rows), lambda s: s["column"])
    return catalog.groupBy(*TABLE_KEY).agg(names(F.collect_list(F.when(F.col("is_primary_key"), by))).alias("pk_columns"), names(F.collect_list(by)).alias("columns"))


def tables_in_play(events: DataFrame, snapshot: DataFrame) -> DataFrame:
    return events.select(*TABLE_KEY).union(snapshot.select(*TABLE_KEY)).distinct()


def table_gate(events: DataFrame, snapshot: DataFrame, catalog: DataFrame) -> DataFrame:
    """Tables that cannot be correlated: (table, rule_id), no catalog (R-CORR-021) or no key (R-CORR-020)."""
    known = tables_in_play(events, snapshot).join(table_keys(catalog), TABLE_KEY, "left")
    rule = F.when(F.col("pk_columns").isNull(), "R-CORR-021").when(F.size("pk_columns") == 0, "R-CORR-020")
    return known.select(*TABLE_KEY, rule.alias("rule_id")).filter("rule_id is not null")


def _key(image: Column, under: Column | None = None) -> Column:
    """Rendered key of an image (over another one where it lacks a column); null if any part cannot be a key."""
    get = (lambda c: image[c]) if under is None else (lambda c: F.coalesce(image[c], under[c]))
    parts = F.transform("pk_columns", lambda c: render_key(get(c)))
    return F.when((F.size("pk_columns") > 0) & image.isNotNull() & ~F.exists(parts, lambda p: p.isNull()), parts)


def keyed_events(events: DataFrame, catalog: DataFrame) -> DataFrame:
    """events with key (INSERT after, DELETE before, UPDATE before overlaid by after) and before_key, as arrays of text, and where there is no key why."""
    rows = events.join(table_keys(catalog), TABLE_KEY, "left")
    update = _key(F.coalesce("after", "before"), F.col("before"))
    key = F.when(F.col("event_type") == "INSERT", _key(F.col("after"))).when(F.col("event_type") == "DELETE", _key(F.col("before"))).otherwise(update)
    before = F.when(F.col("event_type") == "UPDATE", _key(F.col("before")))
    return rows.withColumns({"key": key, "before_key": before}).withColumn("unusable", F.when(F.col("key").isNull(), unusable()))


def key_changes(keyed: DataFrame) -> DataFrame:
    """Distinct (before_pk, after_pk) of UPDATEs that change the key, committed or not."""
    moved = keyed.filter("event_type = 'UPDATE' and key is not null and before_key is not null and key <> before_key")
    return moved.select(*TABLE_KEY, record_pk(F.col("before_key")).alias("before_pk"), record_pk(F.col("key")).alias("after_pk")).distinct()


def continuity(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(aliases, refused): (pk, canonical) of keys that lead to one last key, and keys whose continuation is not determined
    (R-CORR-011): several successors, several predecessors, or a cycle.

    Pointer jumping doubles the steps each round, so a chain of n needs log2(n) rounds; links still moving after
    enough rounds for all of them go round in a cycle.
    """
    links = settle(changes)
    out = links.groupBy(*TABLE_KEY, F.col("before_pk").alias("pk")).agg(F.count("*").alias("n"), F.collect_set("after_pk").alias("others"))
    into = links.groupBy(*TABLE_KEY, F.col("after_pk").alias("pk")).agg(F.count("*").alias("n"), F.collect_set("before_pk").alias("others"))
    forked = out.filter("n > 1").unionByName(into.filter("n > 1"))
    unclear = forked.select(*TABLE_KEY, "pk").union(forked.select(*TABLE_KEY, F.explode("others"))).distinct()
    unclear = settle(unclear)
    clear = links.join(unclear.withColumnRenamed("pk", "before_pk"), [*TABLE_KEY, "before_pk"], "left_anti").join(unclear.withColumnRenamed("pk", "after_pk"), [*TABLE_KEY, "after_pk"], "left_anti")
    jumps = settle(clear.select(*TABLE_KEY, F.col("before_pk").alias("pk"), F.col("after_pk").alias("canonical")))
    rounds = max(1, jumps.count().bit_length() + 1)
    for _ in range(rounds):
        onward = jumps.select(*TABLE_KEY, F.col("pk").alias("canonical"), F.col("canonical").alias("next"))
        jumps = settle(jumps.join(onward, [*TABLE_KEY, "canonical"], "left").select(*TABLE_KEY, "pk", F.coalesce("next", "canonical").alias("canonical"), F.col("next").isNotNull().alias("moved")))
        still = jumps.filter("moved")
        if still.isEmpty():
            break
        jumps = jumps.drop("moved")
    else:
        circular = still.select(*TABLE_KEY, "pk")
        return jumps.join(circular, [*TABLE_KEY, "pk"], "left_anti").select(*TABLE_KEY, "pk", "canonical"), unclear.unionByName(circular).distinct()
    return jumps.select(*TABLE_KEY, "pk", "canonical"), unclear


def snapshot_keys(snapshot: DataFrame, catalog: DataFrame) -> DataFrame:
    """Snapshot rows with their pk; rows whose key cannot be rendered are left out."""
    rows = snapshot.join(table_keys(catalog), TABLE_KEY).withColumn("key", _key(F.col("values")))
    return rows.filter("key is not null").withColumn("pk", record_pk(F.col("key"))).drop("pk_columns", "columns", "key")


def chosen_rows(keyed_snapshot: DataFrame, *more: str) -> DataFrame:
    """Per key: candidates, live rows, and the row to compare with: the one live row, else the first deleted; none if several live.
    more: columns of that row to take along."""
    live = ~F.col("is_deleted")
    agg = keyed_snapshot.groupBy(*RECORD).agg(F.count("*").alias("candidates"), F.count_if(live).alias("live"), F.min_by(F.struct("snapshot_ord", "is_deleted"), F.struct("is_deleted", "snapshot_ord")).alias("row"), *[F.min_by(c, F.struct("is_deleted", "snapshot_ord")).alias(c) for c in more])
    one = F.when(F.col("live") <= 1, F.col("row"))
    return agg.select(*RECORD, "candidates", "live", one["snapshot_ord"].alias("snapshot_ord"), one["is_deleted"].alias("is_deleted"), *[F.when(F.col("live") <= 1, F.col(c)).alias(c) for c in more])


def record_events(keyed: DataFrame, aliases: DataFrame) -> DataFrame:
    """Events, each once in keyed, under their canonical key; where continuity was refused an UPDATE of the key stands under both."""
    rows = keyed.filter("key is not null").withColumns({"pk": record_pk(F.col("key")), "before_pk_": record_pk(F.col("before_key"))})
    named = lambda df: df.join(aliases, [*TABLE_KEY, "pk"], "left").withColumn("pk", F.coalesce("canonical", "pk")).drop("canonical", "before_pk_")
    plain, moved = rows.filter("before_pk_ is null or before_pk_ = pk"), rows.filter("before_pk_ <> pk").withColumn("pk", F.explode(F.array("pk", "before_pk_")))
    return named(plain).unionByName(named(moved).dropDuplicates([*RECORD, *REF[1:]]))


def reused_after_delete(of_record: DataFrame) -> DataFrame:
    """Records with an INSERT after a DELETE (R-CORR-012)."""
    earlier = Window.partitionBy(*RECORD).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    again = of_record.withColumn("gone_", F.max((F.col("event_type") == "DELETE").cast("int")).over(earlier)).filter("gone_ = 1 and event_type = 'INSERT'")
    return again.select(*RECORD).distinct()


def by_continuity(aliases: DataFrame) -> DataFrame:
    """(record, previous): the earlier keys of each record, in order."""
    return aliases.groupBy(*TABLE_KEY, F.col("canonical").alias("pk")).agg(F.array_sort(F.collect_set("pk")).alias("previous"))


def method() -> Column:
    """What links a record of the log to the snapshot: n_events null or 0 if the log has none, candidates null if the snapshot has none."""
    by_key = F.when(F.size("previous") > 0, "pk_update_continuity").when(F.col("width") > 1, "composite_pk_exact").otherwise("pk_exact")
    from_log = F.when(F.col("candidates").isNull(), "log_only").when(F.col("live") > 1, "ambiguous").otherwise(by_key)
    return F.when(F.col("n_events") > 0, from_log).when(F.col("live") > 1, "ambiguous").otherwise("physical_only")


def widths(catalog: DataFrame) -> DataFrame:
    return table_keys(catalog).select(*TABLE_KEY, F.size("pk_columns").alias("width"))


def matched(logged: DataFrame, rows: DataFrame, aliases: DataFrame, catalog: DataFrame) -> DataFrame:
    """Records of the log (RECORD, n_events) and of the snapshot (chosen_rows) put together, with the method that links them."""
    both = logged.join(rows, RECORD, "full_outer").join(by_continuity(aliases), RECORD, "left").join(widths(catalog), TABLE_KEY, "left").withColumn("method", method())
    none = F.expr("cast(array() as array<string>)")
    counts = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("candidates", "live", "n_events")}
    return both.withColumns(counts | {"previous": F.when(F.col("n_events") > 0, F.coalesce("previous", none)).otherwise(none)}).drop("width")


class Correlation:
    """records: RECORD, method, snapshot_ord and is_deleted of the chosen row, live, candidates, n_events, previous. record_events:
    events of each record without their images, record_images with them. aliases: (pk, canonical). findings: (case_id, rule_id, subject,
    context). unsupported, uncertain: tables. Each is worked out when it is first asked for."""

    def __init__(self, grouping: Grouping, snapshot: DataFrame, catalog: DataFrame):
        self._grouping, self._snapshot, self._catalog = grouping, snapshot, catalog

    @cached_property
    def unsupported(self) -> DataFrame:
        return settle(table_gate(self._grouping.placed, self._snapshot, self._catalog))

    @cached_property
    def uncertain(self) -> DataFrame:
        return settle(self._grouping.placed.filter("key is null").select(*TABLE_KEY).distinct())

    @cached_property
    def _continuity(self) -> tuple[DataFrame, DataFrame]:
        return continuity(key_changes(self._grouping.placed))

    @cached_property
    def aliases(self) -> DataFrame:
        return self._continuity[0]

    @cached_property
    def bound(self) -> DataFrame:
        """Events under their records, without what grouping says of them."""
        return record_events(self._grouping.placed, self.aliases)

    @cached_property
    def record_events(self) -> DataFrame:
        claimed = transaction_of(self._grouping.members)
        events = self._grouping.placed.join(claimed, REF, "left").fillna({"durable": False})
        return settle(record_events(events, self.aliases).drop("pk_columns", "key", "before_key", "unusable", "ingest_ord", "thread_id"))

    @cached_property
    def record_images(self) -> DataFrame:
        return self.record_events.join(self._grouping.images, REF)

    @cached_property
    def rows(self) -> DataFrame:
        """The snapshot's row of each record with its values."""
        return chosen_rows(snapshot_keys(self._snapshot, self._catalog), "values")

    @cached_property
    def records(self) -> DataFrame:
        return settle(self.found)

    @cached_property
    def found(self) -> DataFrame:
        logged = self.bound.groupBy(*RECORD).agg(F.count("*").alias("n_events"))
        found = matched(logged, chosen_rows(snapshot_keys(self._snapshot, self._catalog)), self.aliases, self._catalog)
        return found.select(*RECORD, "method", "snapshot_ord", "is_deleted", "candidates", "live", "n_events", "previous")

    @cached_property
    def findings(self) -> DataFrame:
        keyed, records, of_record, gate = self._grouping.placed, self.records, self.record_events, self.unsupported
        supplied = settle(self._snapshot.select(*TABLE_KEY).distinct())
        name = F.concat("table", F.lit(":"), "pk")
        qualified = F.concat_ws(".", "database", "table")
        event_name = F.concat_ws("", "source_file", F.lit(":"), F.col("log_position").cast("string"), F.lit("#"), F.col("row_index").cast("string"))
        place = {"source_file": F.col("source_file"), "log_position": F.col("log_position"), "row_index": F.col("row_index")}
        unkeyed = keyed.join(gate, TABLE_KEY, "left_anti").filter("key is null")
        return (
            finding(gate, F.col("rule_id"), qualified, table=qualified)
            .unionByName(finding(unkeyed, "R-CORR-003", event_name, **place, reason=F.col("unusable")))
            .unionByName(finding(records.withColumn("old", F.explode("previous")), "R-CORR-010", name, record=name, previous_key=F.concat("table", F.lit(":"), "old")))
            .unionByName(finding(self._continuity[1], "R-CORR-011", name, key=name, reason=F.lit(SEVERAL_CONTINUATIONS)))
            .unionByName(finding(reused_after_delete(of_record), "R-CORR-012", name, record=name))
            .unionByName(finding(records.filter("live > 1"), "R-CORR-022", name, record=name, count=F.col("live")))
            .unionByName(finding(records.filter("live = 1 and candidates > 1"), "R-CORR-023", name, record=name, count=F.col("candidates") - F.col("live")))
            .unionByName(finding(of_record.select(*TABLE_KEY).distinct().join(supplied, TABLE_KEY, "left_anti"), "R-CORR-030", qualified, table=qualified))
            .unionByName(finding(records.filter("n_events = 0"), "R-CORR-031", name, record=name))
            .unionByName(finding(colliding(keyed), "R-ID-002", name, record=name, separator=F.lit("|")))
            .unionByName(finding(shared_table_names(records), "R-ID-003", F.col("table"), table=F.col("table"), databases=F.array_join("names", ", ")))
        )


def correlate(grouping: Grouping, snapshot: DataFrame, catalog: DataFrame) -> Correlation:
    """grouping: of events with their keys (keyed_events)."""
    return Correlation(grouping, snapshot, catalog)


def unusable() -> Column:
    """The first key column whose value cannot be a key, and why."""
    image = F.when(F.col("event_type") == "DELETE", F.col("before")).otherwise(F.coalesce("after", "before"))
    held = lambda c: F.coalesce(image[c], F.when(F.col("event_type") == "UPDATE", F.col("before")[c]))
    why = lambda c: F.when(held(c).isNull(), "not observed").when(held(c)["kind"] == "null", "NULL").otherwise(held(c)["kind"])
    bad = F.filter("pk_columns", lambda c: render_key(held(c)).isNull())
    return F.try_element_at(F.transform(bad, lambda c: F.concat(c, F.lit(": "), why(c))), F.lit(1))


def colliding(keyed: DataFrame) -> DataFrame:
    """(case, pk) of each event whose key has a part that holds the separator (R-ID-002), before the parts are joined."""
    return keyed.filter("key is not null").filter(separator_collides(F.col("key"))).select("case_id", "table", record_pk(F.col("key")).alias("pk"))


def shared_table_names(tables: DataFrame) -> DataFrame:
    """Short table names that stand in several databases (R-ID-003), with the databases' names."""
    return tables.groupBy("case_id", "table").agg(F.array_sort(F.collect_set("database")).alias("names")).filter("size(names) > 1")


def edges(of_record: DataFrame) -> DataFrame:
    """(case, tx_id, record, event_type, refs): which transactions touched which records and how, references in order."""
    ref = F.struct(basename(F.col("source_file")).alias("file"), "log_position", "row_index")
    return of_record.filter("tx_id is not null").groupBy(*RECORD, "tx_id", "event_type").agg(F.array_sort(F.collect_set(ref)).alias("refs"))


def ordered_transactions(of_record: DataFrame) -> DataFrame:
    """Transaction ids of each record in replay order."""
    first = of_record.filter("tx_id is not null").groupBy(*RECORD, "tx_id").agg(F.min("ord").alias("at"))
    return first.groupBy(*RECORD).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "tx_id"))), lambda s: s["tx_id"]).alias("tx_ids"))
