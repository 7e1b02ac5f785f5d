"""Transaction assembly: which events a marker covers, what state the transaction is in, and what no marker covers."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import file_sequence, ranked, with_order
from ..functions.rules import finding
from ..functions.values import basename, suffix
from ..sources.tables import settle

REF = ["case_id", "source_file", "log_position", "row_index"]
MARKER = ["case_id", "source_file", "start_position"]
#: Width of the position buckets that range joins meet on.
SPAN = 4096


def deduplicate(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, repeated): the first row of each full reference by ingest_ord, and the others (R-GRP-013)."""
    n = F.row_number().over(Window.partitionBy(*REF).orderBy("ingest_ord"))
    numbered = events.withColumn("n_", n)
    return numbered.filter("n_ = 1").drop("n_"), numbered.filter("n_ > 1").drop("n_").withColumn("rule_id", F.lit("R-GRP-013"))


def listed_positions(markers: DataFrame) -> DataFrame:
    return markers.select(*MARKER, "end_position", "gtid", F.explode("event_positions").alias("log_position"))


def claim_by_position(events: DataFrame, markers: DataFrame) -> DataFrame:
    """(marker, event) pairs: every row at a position that the marker lists."""
    return events.select(*REF).join(listed_positions(markers).drop("end_position"), ["case_id", "source_file", "log_position"]).select(*MARKER, "gtid", "log_position", "row_index")


def marker_links(events: DataFrame, markers: DataFrame) -> DataFrame:
    """Claims by position with event_order, the place of the position in the marker's list: all rows at a position share it."""
    placed = markers.select(*MARKER, "gtid", F.posexplode("event_positions").alias("event_order", "log_position"))
    return events.select(*REF).join(placed, ["case_id", "source_file", "log_position"]).select(*MARKER, "gtid", "log_position", "row_index", "event_order")


def missing_positions(events: DataFrame, markers: DataFrame) -> DataFrame:
    """Listed positions at which there is no event (R-GRP-009)."""
    return listed_positions(markers).join(events, ["case_id", "source_file", "log_position"], "left_anti").withColumn("rule_id", F.lit("R-GRP-009"))


def in_range(events: DataFrame, markers: DataFrame) -> DataFrame:
    """Events within each marker's range: a join on file and position bucket, so that a long range meets only its own buckets."""
    spread = markers.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start_position") / SPAN), F.floor(F.col("end_position") / SPAN))))
    rows = events.withColumn("bucket", F.floor(F.col("log_position") / SPAN)).withColumnRenamed("thread_id", "event_thread").select(*REF, "event_thread", "bucket")
    return rows.join(spread, ["case_id", "source_file", "bucket"]).filter("log_position between start_position and end_position").drop("bucket")


def unlisted_in_range(events: DataFrame, markers: DataFrame) -> DataFrame:
    """Events inside the range of a marker that lists positions, but not theirs (R-GRP-010); they are not claimed."""
    listing = markers.filter(F.size("event_positions") > 0)
    near = in_range(events, listing.select(*MARKER, "end_position", "event_positions"))
    return near.filter(~F.array_contains("event_positions", F.col("log_position"))).select(*MARKER, "log_position", "row_index", F.lit("R-GRP-010").alias("rule_id"))


def claim_by_session(events: DataFrame, markers: DataFrame, by_position: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(claims, refusals) of markers that list no positions: events in range and of their thread that no earlier marker claimed.

    A marker that sees an event in range without a thread, or that has none itself, claims nothing (R-GRP-008). An event without a
    thread is never claimed, so whether a marker refuses does not depend on other markers' claims, and an event goes to
    the first marker in order of (start, gtid) that does not refuse and has its thread: an aggregate over pairs in
    range, however markers overlap. A refusal counts the events that no earlier marker took.
    """
    session = markers.filter(F.size("event_positions") == 0).select(*MARKER, "end_position", "gtid", "thread_id")
    taken = by_position.groupBy(*REF).agg(F.min("start_position").alias("taken_at"))
    seen = in_range(events, session).join(taken, REF, "left").filter(F.col("taken_at").isNull() | (F.col("taken_at") >= F.col("start_position")))
    turn = F.struct(F.col("start_position").alias("at"), F.col("gtid").isNull().alias("bare"), F.coalesce("gtid", F.lit("")).alias("gtid"))
    near = settle(seen.select(*REF, "start_position", "end_position", "gtid", "event_thread", "thread_id", turn.alias("turn")))
    own = ["case_id", "source_file", "turn"]
    refusing = settle(near.groupBy(*own).agg(F.bool_or(F.col("thread_id").isNull() | F.col("event_thread").isNull()).alias("refuses")).filter("refuses").select(*own))
    able = near.filter("event_thread = thread_id").join(refusing, own, "left_anti")
    owners = settle(able.groupBy(*REF).agg(F.min("turn").alias("owner")))
    claims = owners.select("case_id", "source_file", F.col("owner.at").alias("start_position"), F.when(~F.col("owner.bare"), F.col("owner.gtid")).alias("gtid"), "log_position", "row_index")
    left = near.join(refusing, own, "left_semi").join(owners, REF, "left").filter("owner is null or owner >= turn")
    refusals = left.groupBy(*MARKER, "turn").agg(F.countDistinct("log_position", "row_index").alias("refused")).drop("turn")
    return claims, refusals.withColumn("rule_id", F.lit("R-GRP-008"))


def session_key() -> Column:
    by_thread = F.concat_ws(":", "source_file", F.col("thread_id").cast("string"))
    return F.coalesce(F.when(F.col("gtid") != "", F.col("gtid")), F.when(F.col("thread_id").isNotNull(), by_thread), F.concat_ws(":", "source_file", F.col("start_position").cast("string")))


def provisional_id() -> Column:
    """TX-<sequence of the gtid>, else (no gtid, or one without a sequence) TX-<file suffix>@<start>."""
    return F.when(F.contains("gtid", F.lit(":")), F.concat(F.lit("TX-"), F.substring_index("gtid", ":", -1))).otherwise(F.concat(F.lit("TX-"), suffix(F.col("source_file")), F.lit("@"), F.col("start_position").cast("string")))


def named(markers: DataFrame) -> DataFrame:
    """markers with tx_id and the number of the case's server ids; where there are several, eight characters of the marker's own go before (R-TXID-001)."""
    server = F.when(F.contains("gtid", F.lit(":")), F.regexp_extract("gtid", "^(.*):", 1))
    servers = markers.groupBy("case_id").agg(F.countDistinct(server).alias("servers"))
    own = markers.join(servers, "case_id").withColumn("server", server)
    several = (F.col("servers") > 1) & F.col("server").isNotNull()
    return own.withColumn("tx_id", F.when(several, F.concat(F.lit("TX-"), F.substring("server", 1, 8), F.lit("-"), F.substring_index("gtid", ":", -1))).otherwise(provisional_id())).drop("server")


def missing_later(markers: DataFrame, log_files: DataFrame) -> DataFrame:
    """markers with later_missing, whether the list names a missing file after the marker's own, and missing_files, their names.

    The list of files is bounded by what a server keeps.
    """
    lost = log_files.filter("not present").groupBy("case_id").agg(F.array_sort(F.collect_set(F.struct("seq", basename(F.col("file")).alias("file")))).alias("lost"))
    placed = markers.withColumn("file", basename(F.col("source_file"))).join(file_sequence(log_files), ["case_id", "file"], "left").join(lost, "case_id", "left")
    later = F.coalesce(F.transform(F.filter("lost", lambda x: x["seq"] > F.col("file_seq")), lambda x: x["file"]), F.expr("cast(array() as array<string>)"))
    return placed.withColumn("missing_files", F.array_join(later, ", ")).withColumn("later_missing", F.size(later) > 0).drop("file", "lost")


IMAGES = ("before", "after")
#: What identity.keyed_events adds.
KEYS = ("pk_columns", "key", "before_key", "unusable")


class Grouping:
    """events: each once, with ord. transactions: one row each. tx_events: (case_id, tx_id, event reference, event_order, durable).
    findings: (case_id, rule_id, subject, context).

    Nothing is worked out before it is asked for, and what is asked for takes along only what it needs: row images are wide, so
    they stay out of what is grouped (placed) and are read again where they are shown.
    """

    def __init__(self, events: DataFrame, markers: DataFrame, log_files: DataFrame):
        self._given, self._markers, self._log_files = events, markers, log_files

    @cached_property
    def events(self) -> DataFrame:
        return with_order(deduplicate(self._given.drop(*KEYS))[0], self._log_files)

    @cached_property
    def images(self) -> DataFrame:
        """(event reference, before, after) of each event."""
        return deduplicate(self._given.select(*REF, "ingest_ord", *IMAGES))[0].drop("ingest_ord")

    @cached_property
    def placed(self) -> DataFrame:
        """events without their images, written once."""
        return settle(with_order(deduplicate(self._given.drop(*IMAGES))[0], self._log_files))

    @cached_property
    def markers(self) -> DataFrame:
        """markers with tx_id, session_key, the place of their file and the files missing after it."""
        return settle(missing_later(named(self._markers), self._log_files).withColumn("session_key", session_key()))

    @cached_property
    def _claims(self) -> tuple[DataFrame, DataFrame]:
        """(member, refused): each claimed event with its transaction, and refusals of markers that list no positions."""
        told = [*REF, "ord", "event_type", "ts"]
        at = self.markers.select(*MARKER, "tx_id", "status", F.explode("event_positions").alias("log_position"))
        listed = self.placed.select(*told).join(at, ["case_id", "source_file", "log_position"]).select(*told, "start_position", "tx_id", "status")
        by_session, refused = claim_by_session(self.placed, self.markers, listed)
        own = self.markers.filter(F.size("event_positions") == 0).select(*MARKER, "tx_id", "status", F.coalesce("gtid", F.lit("")).alias("gtid_"))
        of_session = by_session.withColumn("gtid_", F.coalesce("gtid", F.lit(""))).join(own, [*MARKER, "gtid_"]).join(self.placed.select(*told), REF).select(*told, "start_position", "tx_id", "status")
        return settle(listed.unionByName(of_session)), refused

    @cached_property
    def _loose(self) -> tuple[DataFrame, DataFrame]:
        """(leading, orphans): unclaimed events before the case's first marker, and the others."""
        loose = self.placed.join(self._claims[0].select(*REF), REF, "left_anti")
        first = settle(self.markers.groupBy("case_id").agg(F.min(F.struct(F.coalesce("file_seq", F.lit(0)).alias("seq"), F.col("source_file").alias("name"), F.col("start_position").alias("position"))).alias("first_")))
        place = F.struct(F.col("ord.seq").alias("seq"), F.col("source_file").alias("name"), F.col("log_position").alias("position"))
        split = loose.join(first, "case_id", "left").withColumn("leading", F.col("first_").isNull() | (place < F.col("first_")))
        return split.filter("leading"), split.filter("not leading").drop("first_", "leading")

    @cached_property
    def orphans(self) -> DataFrame:
        return self._loose[1]

    @cached_property
    def _starts(self) -> DataFrame:
        """The run of leading events of each case as one transaction."""
        synthetic_id = F.concat(F.lit("TX-SYNTH-"), suffix(F.col("first_ev.source_file")), F.lit("@"), F.col("first_ev.log_position").cast("string"))
        leading = self._loose[0]
        return settle(leading.groupBy("case_id").agg(F.min_by(F.struct("source_file", "log_position"), "ord").alias("first_ev"), F.max_by("log_position", "ord").alias("end_position"), F.count("*").alias("n_events"), *_by_type()).withColumn("tx_id", synthetic_id))

    @cached_property
    def synthetic(self) -> DataFrame:
        return self._starts.select(
            "case_id", "tx_id", F.lit("incomplete").alias("status"), F.lit("events_without_begin").alias("reason"), F.lit("R-GRP-005").alias("rule_id"), F.col("first_ev.source_file").alias("source_file"),
            F.col("first_ev.log_position").alias("start_position"), "end_position", F.concat("first_ev.source_file", F.lit(":synthesised")).alias("session_key"), F.lit(0).alias("file_seq"), F.lit(None).cast("long").alias("commit_position"), F.lit(None).cast("timestamp").alias("commit_ts"), F.lit(True).alias("synthesised"), "n_events", "n_insert", "n_update", "n_delete",
        )

    @cached_property
    def marked(self) -> DataFrame:
        """The transactions that have a marker."""
        counts = self._claims[0].groupBy("case_id", "tx_id").agg(F.count("*").alias("n_events"), *_by_type(), F.max_by("ts", "ord").alias("last_ts"))
        committed = F.col("status") == "committed"
        empty = F.coalesce("n_events", F.lit(0)) == 0
        reason = F.when(F.col("status") == "incomplete", F.when(empty, "marker_without_events").when(F.col("later_missing"), "log_file_missing_in_sequence").otherwise("no_terminator_in_range"))
        rule = F.when(F.col("status") == "incomplete", F.when(empty, "R-GRP-006").when(F.col("later_missing"), "R-GRP-014").otherwise("R-GRP-004")).when(F.col("status") == "rolled_back", "R-GRP-003").when(F.coalesce(F.col("gtid"), F.lit("")) != "", "R-GRP-001").otherwise("R-GRP-002")
        return self.markers.join(counts, ["case_id", "tx_id"], "left").select(
            "case_id", "tx_id", "status", reason.alias("reason"), rule.alias("rule_id"), "source_file", "start_position", "end_position", "session_key", F.coalesce("file_seq", F.lit(0)).alias("file_seq"),
            F.when(committed, F.col("end_position")).alias("commit_position"), F.when(committed, F.col("last_ts")).alias("commit_ts"), F.lit(False).alias("synthesised"),
            *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_events", "n_insert", "n_update", "n_delete")],
        )

    @cached_property
    def transactions(self) -> DataFrame:
        return self.marked.unionByName(self.synthetic)

    @cached_property
    def members(self) -> DataFrame:
        """tx_events without their order within the transaction."""
        shown = [*REF, "tx_id", "start_position", "ord", "durable", "status", "event_type", "ts"]
        headed = self._loose[0].join(self._starts.select("case_id", "tx_id", F.col("first_ev.log_position").alias("start_position")), "case_id")
        return self._claims[0].withColumn("durable", F.col("status") == "committed").select(*shown).unionByName(headed.withColumns({"durable": F.lit(False), "status": F.lit("incomplete")}).select(*shown))

    @cached_property
    def tx_events(self) -> DataFrame:
        per_tx = Window.partitionBy("case_id", "tx_id").orderBy("ord")
        claimed = self._claims[0].select(*REF, "tx_id", "start_position", "ord", (F.row_number().over(per_tx) - 1).alias("event_order"), (F.col("status") == "committed").alias("durable"), "status", "event_type", "ts")
        headed = ranked(self._loose[0], [F.col("ord")], "event_order")
        led = headed.join(self._starts.select("case_id", "tx_id", F.col("first_ev.log_position").alias("start_position")), "case_id").select(*REF, "tx_id", "start_position", "ord", F.col("event_order").cast("int").alias("event_order"), F.lit(False).alias("durable"), F.lit("incomplete").alias("status"), "event_type", "ts")
        return settle(claimed.unionByName(led))

    @cached_property
    def findings(self) -> DataFrame:
        marked, kept, told_of = self.markers, self.placed, settle(self.marked)
        repeated = deduplicate(self._given.drop(*IMAGES))[1]
        tx = F.col("tx_id")
        where = {"source_file": F.col("source_file"), "log_position": F.col("log_position")}
        event_name = F.concat_ws("", "source_file", F.lit(":"), F.col("log_position").cast("string"), F.lit("#"), F.col("row_index").cast("string"))
        sessions = told_of.groupBy("case_id").agg(F.countDistinct("session_key").alias("sessions")).filter("sessions > 1")
        told = told_of.join(marked.select("case_id", "tx_id", "source_file", "start_position", "gtid", "xid", "missing_files"), ["case_id", "tx_id", "source_file", "start_position"])
        marker_name = marked.select(*MARKER, "tx_id").distinct()
        return settle(
            finding(told, F.col("rule_id"), tx, transaction=tx, gtid=F.col("gtid"), xid=F.col("xid"), source_file=F.col("source_file"), missing_files=F.col("missing_files"))
            .unionByName(finding(self.synthetic, F.col("rule_id"), tx, count=F.col("n_events"), source_file=F.col("source_file")))
            .unionByName(finding(repeated, "R-GRP-013", event_name, **where, row_index=F.col("row_index")))
            .unionByName(finding(missing_positions(kept, marked).join(marker_name, MARKER), "R-GRP-009", tx, transaction=tx, **where))
            .unionByName(finding(unlisted_in_range(kept, marked).join(marker_name, MARKER), "R-GRP-010", event_name, transaction=tx, **where, row_index=F.col("row_index")))
            .unionByName(finding(self._claims[1].join(marker_name, MARKER), "R-GRP-008", tx, transaction=tx, count=F.col("refused")))
            .unionByName(finding(self.orphans, "R-GRP-011", event_name, **where, row_index=F.col("row_index")))
            .unionByName(finding(told_of.join(sessions, "case_id", "left_semi"), "R-GRP-007", tx, transaction=tx, session_key=F.col("session_key")))
            .unionByName(finding(repeated_gtids(marked), "R-GRP-012", tx, gtid=F.col("gtid"), count=F.col("n")))
            .unionByName(finding(marked.filter("servers > 1").filter(F.contains("gtid", F.lit(":"))), "R-TXID-001", tx, transaction=tx, gtid=F.col("gtid")))
        )


def _by_type() -> list[Column]:
    return [F.count_if(F.col("event_type") == t).alias(f"n_{t.lower()}") for t in ("INSERT", "UPDATE", "DELETE")]


def group(events: DataFrame, markers: DataFrame, log_files: DataFrame) -> Grouping:
    return Grouping(events, markers, log_files)


def duplicate_ids(transactions: DataFrame) -> DataFrame:
    """Transaction ids that several transactions of a case carry (R-GRP-012)."""
    return transactions.filter("not synthesised").groupBy("case_id", "tx_id").agg(F.count("*").alias("n")).filter("n > 1")


def repeated_gtids(named_markers: DataFrame) -> DataFrame:
    """(case_id, tx_id, gtid, n): ids taken from a gtid that several transactions carry (R-GRP-012), in cases of one server at most."""
    first = F.min_by(F.struct("gtid"), F.struct("source_file", "start_position"))
    ids = named_markers.filter("servers <= 1").groupBy("case_id", "tx_id").agg(F.count("*").alias("n"), first["gtid"].alias("gtid"))
    return ids.filter("n > 1 and gtid <> ''")


def transaction_of(tx_events: DataFrame) -> DataFrame:
    """Each event's transaction; of several claims the last transaction's."""
    return tx_events.groupBy(*REF).agg(F.max_by(F.struct("tx_id", "durable", "status"), F.struct("start_position", "tx_id")).alias("tx")).select(*REF, "tx.*")


def coverage_gaps(log_files: DataFrame, markers: DataFrame) -> DataFrame:
    """(case_id, rule_id, missing_file, after_file, before_file, after_position): no list at all, missing files between
    their nearest present neighbours, and logs that end inside a transaction with no later file known to be missing."""
    by_seq = Window.partitionBy("case_id").orderBy("seq")
    held = F.when(F.col("present"), basename(F.col("file")))
    around = log_files.withColumn("after_file", F.last(held, True).over(by_seq.rowsBetween(Window.unboundedPreceding, -1))).withColumn("before_file", F.first(held, True).over(by_seq.rowsBetween(1, Window.unboundedFollowing)))
    none = F.lit(None)
    lost = around.filter("not present").select("case_id", F.lit("R-COV-002").alias("rule_id"), basename(F.col("file")).alias("missing_file"), "after_file", "before_file", none.cast("long").alias("after_position"))
    cut_off = missing_later(markers.filter("status = 'incomplete'"), log_files).filter("not later_missing").select("case_id", F.lit("R-COV-003").alias("rule_id"), none.cast("string").alias("missing_file"), basename(F.col("source_file")).alias("after_file"), none.cast("string").alias("before_file"), F.col("start_position").alias("after_position"))
    bare = markers.select("case_id").distinct().join(log_files, "case_id", "left_anti").select("case_id", F.lit("R-COV-001").alias("rule_id"), *[none.cast(t).alias(c) for c, t in (("missing_file", "string"), ("after_file", "string"), ("before_file", "string"), ("after_position", "long"))])
    return lost.unionByName(cut_off).unionByName(bare)


def coverage_findings(log_files: DataFrame, markers: DataFrame) -> DataFrame:
    """Findings of the gaps: no list (R-COV-001), a missing file (002), a log that ends inside a transaction (003)."""
    file = basename(F.col("source_file"))
    cut_off = missing_later(named(markers).filter("status = 'incomplete'"), log_files).filter("not later_missing")
    bare = markers.select("case_id").distinct().join(log_files, "case_id", "left_anti")
    lost = log_files.filter("not present").withColumn("source_file", basename(F.col("file")))
    return (
        finding(lost, "R-COV-002", F.col("source_file"), source_file=F.col("source_file"))
        .unionByName(finding(cut_off, "R-COV-003", file, source_file=file, transaction=provisional_id()))
        .unionByName(finding(bare, "R-COV-001", F.lit("binlog-index")))
    )


def coverage(cases: DataFrame, gaps: DataFrame) -> DataFrame:
    """(case_id, complete): one row per case; complete means a list of files and no gap."""
    return cases.select("case_id").distinct().join(gaps.groupBy("case_id").agg(F.count("*").alias("gaps")), "case_id", "left").select("case_id", F.col("gaps").isNull().alias("complete"), F.coalesce("gaps", F.lit(0)).alias("gaps"))


def missing_provenance(events: DataFrame, recorded: DataFrame) -> DataFrame:
    """Files with an event that neither carries its provenance nor has one on record (R-PROV-001), once per file."""
    return events.join(recorded.select(*REF), REF, "left_anti").select("case_id", "source_file").distinct().withColumn("rule_id", F.lit("R-PROV-001"))


def tables_touched(tx_events: DataFrame, events: DataFrame) -> DataFrame:
    """(case_id, tx_id, tables): the tables of each transaction's events, in order of their names."""
    named = events.select(*REF, F.concat_ws(".", "database", "table").alias("table_"))
    return tx_events.select(*REF, "tx_id").join(named, REF).groupBy("case_id", "tx_id").agg(F.array_sort(F.collect_set("table_")).alias("tables"))
