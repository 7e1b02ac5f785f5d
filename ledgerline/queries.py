"""One query per operator, and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import ordering, rules, values
from .operators import history, identity, quality, reconcile, reports, scope, serving, transactions
from .oracle import CATALOGUE, FOUND, STEPS, chain
from .plans.analysis import Analysis, analyse
from .plans.change_log import Case, derive
from .sources import text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_kept: dict = {}


def case_of(spark: SparkSession, sf_dir: str) -> Case:
    return derive(spark, sf_dir)


def analysis_of(spark: SparkSession, sf_dir: str) -> Analysis:
    """The analysis of a folder, run once a session; its stages are written tables."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _kept:
        _kept[key] = analyse(case_of(spark, sf_dir))
    return _kept[key]


def query(name: str, sql: str | None, on: str = "analysis"):
    """Register a query. on: what its function gets, the analysis, the case, or (spark, sf_dir)."""

    def add(fn):
        run = {"analysis": lambda s, d: fn(analysis_of(s, d)), "case": lambda s, d: fn(case_of(s, d)), "tables": fn, "both": lambda s, d: fn(case_of(s, d), analysis_of(s, d))}[on]
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return add


FILE = "'log.00000' || CAST({} AS VARCHAR)"
EVENT = "case_id, 'log.00000' || CAST(f AS VARCHAR) AS source_file, pos AS log_position, ri AS row_index"
REC = "case_id, CAST(key AS VARCHAR) AS pk"


def ref(df: DataFrame, *more) -> DataFrame:
    return df.select("case_id", "source_file", "log_position", F.col("row_index").cast("long").alias("row_index"), *more)


def rec(df: DataFrame, *more) -> DataFrame:
    return df.select("case_id", "pk", *more)


# --- sources, projection, order ---------------------------------------------------------------------------------------

query("s14_log_inventory", "SELECT 'B' AS case_id, 'log.000007' AS file", "case")(lambda c: c.log_files.filter("not present").select("case_id", values.basename(F.col("file")).alias("file")))
query("s18_repeated_references", chain("SELECT case_id, 'log.00000' || CAST(f AS VARCHAR) AS source_file, pos AS log_position, ri AS row_index, count(*) AS n FROM ev1 GROUP BY ALL HAVING count(*) > 1"), "case")(
    lambda c: ref(quality.repeated_references(c.events), "n")
)
query("s19_marker_event_links", chain("SELECT e.case_id, m.tx AS tx_id, e.pos AS log_position, e.ri AS row_index, dense_rank() OVER (PARTITION BY e.case_id, m.tx ORDER BY e.pos) - 1 AS event_order FROM mkn m JOIN ev e ON e.case_id = m.case_id AND e.h = m.h WHERE NOT m.ses"), "case")(
    lambda c: transactions.marker_links(transactions.deduplicate(c.events)[0], transactions.named(c.markers)).join(transactions.named(c.markers).select(*transactions.MARKER, "tx_id"), transactions.MARKER).select("case_id", "tx_id", "log_position", F.col("row_index").cast("long").alias("row_index"), F.col("event_order").cast("long").alias("event_order"))
)


@query("p01_scope_filter", chain("SELECT case_id, count(*) AS events FROM ev1 WHERE case_id = 'A' GROUP BY ALL"), "case")
def p01(c: Case) -> DataFrame:
    wanted = c.catalog.select("database", "table").distinct()
    return scope.within(c.events.filter("case_id = 'A'"), databases=("nothing",), tables=wanted).groupBy("case_id").agg(F.count("*").alias("events"))


query("p02_scope_counts", chain("SELECT (SELECT count(*) FROM ev1) AS events, (SELECT count(*) FROM sn) AS snapshot_rows"), "case")(
    lambda c: scope.within(c.events, databases=("shop",)).agg(F.count("*").alias("events")).crossJoin(scope.within(c.snapshot, databases=("shop",)).agg(F.count("*").alias("snapshot_rows")))
)
query("p03_narrowed_markers", chain("SELECT m.case_id, m.tx AS tx_id, CASE WHEN m.ses THEN 0 ELSE (SELECT count(DISTINCT e.pos) FROM ev e WHERE e.case_id = m.case_id AND e.h = m.h AND e.pos % 200 = 0) END AS positions FROM mkn m WHERE m.ses OR EXISTS (SELECT 1 FROM ev e WHERE e.case_id = m.case_id AND e.h = m.h AND e.pos % 200 = 0)"), "case")(
    lambda c: scope.narrow_markers(transactions.named(c.markers), c.events.filter("log_position % 200 = 0")).select("case_id", "tx_id", F.size("event_positions").cast("long").alias("positions"))
)
query("p04_counts_by_table", chain("SELECT case_id, count(*) AS events, count(DISTINCT f) AS files FROM ev1 GROUP BY case_id"), "case")(
    lambda c: c.events.groupBy("case_id").agg(F.count("*").alias("events"), F.countDistinct("source_file").alias("files"))
)
query("p07_deleted_rows", chain("SELECT case_id, so AS snapshot_ord FROM sn WHERE del"), "case")(lambda c: c.snapshot.filter("is_deleted").select("case_id", "snapshot_ord"))
query("p08_rows_at_position", chain("SELECT case_id, pos AS log_position, count(*) AS n FROM ev WHERE f = 4 GROUP BY ALL HAVING count(*) > 1"), "case")(
    lambda c: transactions.deduplicate(c.events)[0].filter("source_file = 'log.000004'").groupBy("case_id", "log_position").agg(F.count("*").alias("n")).filter("n > 1")
)
query("f02_numeric", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS whole FROM lineitem", "tables")(
    lambda s, d: s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", values.numeric(F.struct(F.lit("str").alias("kind"), F.concat(F.lit(" +00"), F.col("l_quantity").cast("string")).alias("text"))).cast("long").alias("whole"))
)
query("f05_record_id", "SELECT l_orderkey, l_linenumber, 'lineitem:' || CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR) AS record_id FROM lineitem", "tables")(
    lambda s, d: s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", values.record_id(F.lit("lineitem"), F.array(F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))).alias("record_id"))
)
query("f11_digest", "SELECT c_custkey, sha256(c_name || '/' || c_mktsegment) AS digest FROM customer", "tables")(
    lambda s, d: s.read.parquet(f"{d}/customer.parquet").select("c_custkey", values.digest(F.concat_ws("/", "c_name", "c_mktsegment")).alias("digest"))
)
query("o02_event_order", chain("SELECT " + EVENT + ", row_number() OVER (PARTITION BY case_id ORDER BY f, pos, ri) - 1 AS ordinal FROM ev"))(lambda a: ref(ordering.ranked(a.grouping.events.select(*transactions.REF, "ord"), [F.col("ord")]), "ordinal"))
query("o03_transaction_order", chain("SELECT case_id, tx AS tx_id, row_number() OVER (PARTITION BY case_id ORDER BY f, s) - 1 AS ordinal FROM mkn"))(
    lambda a: ordering.ranked(a.grouping.transactions.filter("not synthesised"), [F.col("file_seq"), F.col("start_position")]).select("case_id", "tx_id", "ordinal")
)
query("o04_record_order", chain("SELECT " + REC + ", row_number() OVER (PARTITION BY case_id ORDER BY key) - 1 AS ordinal FROM rec"))(lambda a: rec(ordering.ranked(a.correlation.found.select("case_id", "table", "pk"), [F.col("table"), ordering.key_order(F.col("pk"))]), "ordinal"))
query("o05_page", chain("SELECT * FROM (SELECT " + REC + ", row_number() OVER (PARTITION BY case_id ORDER BY key) - 1 AS ordinal FROM rec) WHERE ordinal BETWEEN 100 AND 199"))(
    lambda a: serving.page(rec(ordering.ranked(a.correlation.found.select("case_id", "table", "pk"), [F.col("table"), ordering.key_order(F.col("pk"))]), "ordinal"), 100, 100)
)
query("o06_locate", chain("SELECT case_id, pk, (ordinal // 100) * 100 AS page FROM (SELECT " + REC + ", row_number() OVER (PARTITION BY case_id ORDER BY key) - 1 AS ordinal FROM rec)"))(
    lambda a: serving.locate(rec(ordering.ranked(a.correlation.found.select("case_id", "table", "pk"), [F.col("table"), ordering.key_order(F.col("pk"))]), "ordinal"))
)
query("o08_worst_of", chain("SELECT " + REC + ", arg_max(res, CASE res WHEN 'Exact' THEN 0 WHEN 'Strong' THEN 1 WHEN 'Unsupported' THEN 3 WHEN 'Unresolved' THEN 4 ELSE 5 END) AS worst FROM vr GROUP BY ALL"))(
    lambda a: a.reconciliation.fields.groupBy("case_id", "pk").agg(F.max_by("result", reconcile.severity(F.col("result"))).alias("worst"))
)

# --- transactions -----------------------------------------------------------------------------------------------------

query("t01_repeated_events", chain("SELECT " + EVENT + " FROM ev1 WHERE cp = 1"), "case")(lambda c: ref(transactions.deduplicate(c.events)[1]))
query("t02_positional_claims", chain("SELECT case_id, tx AS tx_id, pos AS log_position, ri AS row_index FROM pcl"), "case")(lambda c: transactions.claim_by_position(transactions.deduplicate(c.events)[0], c.markers).join(transactions.named(c.markers).select(*transactions.MARKER, "tx_id"), transactions.MARKER).select("case_id", "tx_id", "log_position", F.col("row_index").cast("long").alias("row_index")))
query("t03_missing_positions", chain("SELECT DISTINCT m.case_id, m.file AS source_file, e.pos AS log_position FROM mkn m JOIN ev e ON e.case_id = m.case_id AND e.h = m.h WHERE NOT m.ses AND e.pos % 700 = 0"), "case")(
    lambda c: transactions.missing_positions(c.events.filter("log_position % 700 <> 0"), c.markers).select("case_id", "source_file", "log_position")
)
query("t04_unlisted_in_range", chain("SELECT m.case_id, m.file AS source_file, m.s AS start_position, e.pos AS log_position, e.ri AS row_index FROM mkn m JOIN ev e ON e.case_id = m.case_id AND e.f = m.f AND e.pos BETWEEN m.s AND m.e WHERE NOT m.ses AND e.h <> m.h AND NOT EXISTS (SELECT 1 FROM ev x WHERE x.case_id = m.case_id AND x.h = m.h AND x.pos = e.pos)"), "case")(
    lambda c: transactions.unlisted_in_range(transactions.deduplicate(c.events)[0], c.markers).select("case_id", "source_file", "start_position", "log_position", F.col("row_index").cast("long").alias("row_index"))
)


def _session(c: Case) -> tuple[DataFrame, DataFrame]:
    kept = transactions.deduplicate(c.events)[0]
    return transactions.claim_by_session(kept, c.markers, transactions.claim_by_position(kept, c.markers))


query("t05_session_claims", chain("SELECT case_id, 'log.00000' || CAST(f AS VARCHAR) AS source_file, s AS start_position, pos AS log_position, ri AS row_index FROM scl"), "case")(
    lambda c: _session(c)[0].select("case_id", "source_file", "start_position", "log_position", F.col("row_index").cast("long").alias("row_index"))
)
query("t05_session_refusals", chain("SELECT case_id, tx AS tx_id, n AS refused FROM ref"), "case")(
    lambda c: _session(c)[1].join(transactions.named(c.markers).select(*transactions.MARKER, "tx_id"), transactions.MARKER).select("case_id", "tx_id", "refused")
)
TX_SQL = "WITHTX SELECT m.case_id, m.tx AS tx_id, m.st AS status, CAST(count(c.pos) AS BIGINT) AS n_events, CASE WHEN m.st = 'committed' THEN m.e END AS commit_position, CASE WHEN m.st = 'incomplete' THEN CASE WHEN count(c.pos) = 0 THEN 'marker_without_events' ELSE 'log_file_missing_in_sequence' END END AS reason FROM mkn m LEFT JOIN cl c ON c.case_id = m.case_id AND c.mh = m.h GROUP BY m.case_id, m.tx, m.st, m.e UNION ALL SELECT case_id, 'TX-SYNTH-00000' || CAST(f AS VARCHAR) || '@' || CAST(s AS VARCHAR), 'incomplete', n, NULL, 'events_without_begin' FROM syn"
query("t06_transactions", chain(TX_SQL.removeprefix("WITHTX ")))(lambda a: a.grouping.transactions.select("case_id", "tx_id", "status", "n_events", "commit_position", "reason"))
query("t06_event_types", chain("SELECT t.case_id, t.tx AS tx_id, count(*) FILTER (WHERE e.ty = 'INSERT') AS n_insert, count(*) FILTER (WHERE e.ty = 'UPDATE') AS n_update, count(*) FILTER (WHERE e.ty = 'DELETE') AS n_delete FROM tev t JOIN ev e ON e.case_id = t.case_id AND e.f = t.f AND e.pos = t.pos AND e.ri = t.ri GROUP BY ALL"))(
    lambda a: a.grouping.transactions.filter("n_events > 0").select("case_id", "tx_id", "n_insert", "n_update", "n_delete")
)
query("t07_incompleteness", chain("SELECT case_id, reason, count(*) AS n FROM (" + TX_SQL.removeprefix("WITHTX ") + ") WHERE reason IS NOT NULL GROUP BY ALL"))(
    lambda a: a.grouping.transactions.filter("reason is not null").groupBy("case_id", "reason").agg(F.count("*").alias("n"))
)
query("t08_leading_run", chain("SELECT case_id, s AS start_position, e AS end_position, n AS n_events FROM syn"))(lambda a: a.grouping.transactions.filter("synthesised").select("case_id", "start_position", "end_position", "n_events"))
query("t09_orphans", chain("SELECT " + EVENT + " FROM loose WHERE NOT ldg"))(lambda a: ref(a.grouping.orphans))
query("t10_transaction_ids", chain("SELECT case_id, file AS source_file, s AS start_position, tx AS tx_id FROM mkn"), "case")(lambda c: transactions.named(c.markers).select("case_id", "source_file", "start_position", "tx_id"))
query("t11_duplicate_ids", chain("SELECT case_id, f AS number, count(*) AS n FROM mk WHERE NOT ses GROUP BY case_id, f HAVING count(*) > 1"), "case")(
    lambda c: transactions.duplicate_ids(c.markers.filter("size(event_positions) > 0").withColumns({"tx_id": F.regexp_extract("source_file", "([0-9])$", 1), "synthesised": F.lit(False)})).select("case_id", F.col("tx_id").cast("long").alias("number"), "n")
)
query("t12_session_keys", chain("SELECT case_id, file AS source_file, s AS start_position, uuid || ':' || CAST(f * 100000 + t AS VARCHAR) AS session_key FROM mkn"), "case")(lambda c: c.markers.select("case_id", "source_file", "start_position", transactions.session_key().alias("session_key")))
query("t13_coverage_gaps", "SELECT 'B' AS case_id, 'R-COV-002' AS rule_id, 'log.000007' AS missing_file, 'log.000006' AS after_file, CAST(NULL AS VARCHAR) AS before_file")(lambda a: a.gaps.select("case_id", "rule_id", "missing_file", "after_file", "before_file"))
query("t14_coverage", "SELECT * FROM (VALUES ('A', true, 0), ('B', false, 1)) t(case_id, complete, gaps)")(lambda a: a.coverage)
query("t16_transaction_of_event", chain("SELECT " + EVENT + ", tx AS tx_id, dur AS durable FROM one"))(lambda a: ref(transactions.transaction_of(a.grouping.tx_events), "tx_id", "durable"))

# --- identity ---------------------------------------------------------------------------------------------------------

query("c01_tables_in_play", "SELECT * FROM (VALUES ('A', 'shop', 'orders'), ('B', 'shop', 'orders')) t(case_id, \"database\", \"table\")", "case")(lambda c: identity.tables_in_play(c.events, c.snapshot))
query("c02_table_gate", "SELECT 'A' AS case_id, 'nation' AS \"table\", 'R-CORR-020' AS rule_id UNION ALL SELECT 'A', 'region', 'R-CORR-021'", "tables")(lambda s, d: _gate(s, d))


def _gate(s: SparkSession, d: str) -> DataFrame:
    """region has no catalog and nation no key."""
    rows = [s.read.parquet(f"{d}/{t}.parquet").select(F.lit("A").alias("case_id"), F.lit("main").alias("database"), F.lit(t).alias("table")) for t in ("nation", "region")]
    columns = s.read.parquet(f"{d}/nation.parquet").schema
    catalog = s.createDataFrame([("A", "main", "nation", f.name, n, f.dataType.simpleString(), False) for n, f in enumerate(columns, 1)], "case_id string, database string, table string, column string, position int, data_type string, is_primary_key boolean")
    return identity.table_gate(rows[0], rows[1], catalog).select("case_id", "table", "rule_id")


query("c03_event_keys", chain("SELECT " + EVENT + ", CAST(coalesce(ak, bk) AS VARCHAR) AS pk FROM ev"), "case")(
    lambda c: ref(identity.keyed_events(transactions.deduplicate(c.events)[0], c.catalog), values.record_pk(F.col("key")).alias("pk"))
)
query("c04_key_changes", chain("SELECT case_id, CAST(bk AS VARCHAR) AS before_pk, CAST(ak AS VARCHAR) AS after_pk FROM chg"), "case")(
    lambda c: identity.key_changes(identity.keyed_events(c.events, c.catalog)).select("case_id", "before_pk", "after_pk")
)
query("c05_continuity", chain("SELECT case_id, CAST(bk AS VARCHAR) AS pk, CAST(ak AS VARCHAR) AS canonical FROM ali"))(lambda a: a.correlation.aliases.select("case_id", "pk", "canonical"))
query("c05_refused", chain("SELECT case_id, 'orders:' || CAST(key AS VARCHAR) AS subject FROM amb"))(lambda a: a.correlation.findings.filter("rule_id = 'R-CORR-011'").select("case_id", "subject"))
query("c06_record_events", chain("SELECT " + REC + ", count(*) AS n FROM rev GROUP BY ALL"))(lambda a: a.correlation.bound.groupBy("case_id", "pk").agg(F.count("*").alias("n")))
query("c07_previous_keys", chain("SELECT case_id, CAST(ak AS VARCHAR) AS pk, CAST(bk AS VARCHAR) AS previous FROM ali"))(lambda a: rec(a.correlation.records, F.explode("previous").alias("previous")))
query("c08_reused_after_delete", chain("SELECT DISTINCT " + REC + " FROM rev r WHERE ty = 'INSERT' AND EXISTS (SELECT 1 FROM rev x WHERE x.case_id = r.case_id AND x.key = r.key AND x.ty = 'DELETE' AND x.ord < r.ord)"))(lambda a: rec(identity.reused_after_delete(a.correlation.record_events)))
query("c09_snapshot_keys", chain("SELECT case_id, CAST(sk AS VARCHAR) AS pk, so AS snapshot_ord FROM sn"), "case")(lambda c: rec(identity.snapshot_keys(c.snapshot, c.catalog), "snapshot_ord"))
query("c10_chosen_rows", chain("SELECT " + REC + ", n AS candidates, live, so AS snapshot_ord FROM pick"), "case")(lambda c: rec(identity.chosen_rows(identity.snapshot_keys(c.snapshot, c.catalog)), "candidates", "live", "snapshot_ord"))
query("c11_methods", chain("SELECT " + REC + ", method FROM rm"))(lambda a: rec(a.correlation.found, "method"))
query("c12_snapshot_only", chain("SELECT " + REC + ", cands AS candidates FROM rm WHERE NOT logged"))(lambda a: rec(a.correlation.found.filter("n_events = 0"), "candidates"))
query("c13_selected_values", chain("SELECT r.case_id, CAST(r.key AS VARCHAR) AS pk, CAST(r.price AS VARCHAR) AS price FROM rm r WHERE r.so IS NOT NULL"), "both")(
    lambda c, a: a.correlation.found.join(c.snapshot.select("case_id", "database", "table", "snapshot_ord", "values"), ["case_id", "database", "table", "snapshot_ord"]).select("case_id", "pk", F.col("values")["price_cents"]["text"].alias("price"))
)
query("c14_edges", chain("SELECT " + REC + ", tx AS tx_id, ty AS event_type, count(*) AS refs FROM rev WHERE tx IS NOT NULL GROUP BY ALL"))(lambda a: rec(identity.edges(a.correlation.record_events), "tx_id", "event_type", F.size("refs").cast("long").alias("refs")))
query("c15_ordered_transactions", chain("SELECT case_id, pk, string_agg(tx, ',' ORDER BY first_at) AS tx_ids FROM (SELECT " + REC + ", tx, min(ord) AS first_at FROM rev WHERE tx IS NOT NULL GROUP BY ALL) GROUP BY ALL"))(
    lambda a: rec(identity.ordered_transactions(a.correlation.record_events), F.array_join("tx_ids", ",").alias("tx_ids"))
)
query("c17_uncertain_tables", "SELECT * FROM (VALUES ('A', 'orders'), ('B', 'orders')) t(case_id, \"table\")", "case")(
    lambda c: identity.keyed_events(c.events.filter("event_type = 'INSERT'").withColumn("after", F.map_filter("after", lambda k, _: (k != "o_orderkey") | (F.col("log_position") % 900 != 0))), c.catalog).filter("key is null").select("case_id", "table").distinct()
)

# --- history ----------------------------------------------------------------------------------------------------------

query("h01_earliest_state", chain("SELECT " + REC + ", CASE WHEN t0 = 'INSERT' THEN 'absent' ELSE 'present' END AS presence, CASE WHEN t0 <> 'INSERT' THEN CAST(p0 AS VARCHAR) END AS price FROM rl"))(
    lambda a: rec(history.first_events(a.correlation.record_images), F.when(F.col("first.event_type") == "INSERT", "absent").otherwise("present").alias("presence"), F.when(F.col("first.event_type") != "INSERT", F.col("first.before")["price_cents"]["text"]).alias("price"))
)
query("h02_durable_price", chain("SELECT " + REC + ", CAST(pd AS VARCHAR) AS price FROM rec WHERE logged"))(
    lambda a: a.history.presence.join(a.history.states.filter("column = 'price_cents'"), identity.RECORD, "left").select("case_id", "pk", F.col("durable.text").alias("price"))
)
query("h03_presence", chain("SELECT " + REC + ", lp AS presence FROM pre WHERE logged"))(lambda a: rec(a.history.presence, "presence"))
query("h04_speculative_price", chain("SELECT " + REC + ", CAST(psp AS VARCHAR) AS price FROM rec WHERE logged AND psp IS NOT NULL"))(lambda a: rec(a.history.states.filter("column = 'price_cents' and speculative is not null"), F.col("speculative.text").alias("price")))
query("h05_values_logged", chain("SELECT " + REC + ", count(DISTINCT ap) AS n FROM rev WHERE ty <> 'DELETE' GROUP BY ALL"))(lambda a: history.logged_values(a.history.cells).filter("column = 'price_cents'").groupBy("case_id", "pk").agg(F.countDistinct("new").alias("n")))
query("h06_partial_columns", chain("SELECT " + REC + ", 'o_custkey,o_orderpriority,o_orderstatus' AS partial FROM rl WHERE part"))(lambda a: rec(a.history.partial, F.array_join("partial", ",").alias("partial")))
query("h07_contradictions", chain("SELECT " + REC + " FROM con"))(lambda a: rec(a.history.contradicted))
query("h08_step_kinds", chain("SELECT " + REC + ", row_number() OVER (PARTITION BY case_id, key ORDER BY ord) - 1 AS step, CASE WHEN st IS NULL OR st = 'incomplete' THEN 'R-HIST-006' WHEN st = 'rolled_back' THEN 'R-HIST-005' WHEN ty = 'DELETE' THEN 'R-HIST-004' ELSE 'R-HIST-003' END AS rule_id FROM rev"))(
    lambda a: rec(history.steps(a.correlation.record_events), "step", "rule_id")
)
query("h09_price_changes", chain("SELECT r.case_id, CAST(r.key AS VARCHAR) AS pk, CAST(r.ap AS VARCHAR) AS price FROM rev r JOIN prior p ON p.case_id = r.case_id AND p.key = r.key AND p.ord = r.ord JOIN rl ON rl.case_id = r.case_id AND rl.key = r.key WHERE r.dur AND r.ty <> 'DELETE' AND r.ap IS DISTINCT FROM coalesce(p.pv, CASE WHEN rl.t0 <> 'INSERT' THEN rl.p0 END)"))(
    lambda a: rec(history.field_changes(a.history.cells.filter("column = 'price_cents'")), F.col("new.text").alias("price"))
)
query("h10_presence_steps", chain("SELECT case_id, pk, count(*) FILTER (WHERE was <> is_) AS changes FROM (SELECT r.case_id, CAST(r.key AS VARCHAR) AS pk, coalesce(last_value(CASE WHEN r.dur THEN CASE WHEN r.ty = 'DELETE' THEN 'absent' ELSE 'present' END END IGNORE NULLS) OVER w, CASE WHEN rl.t0 = 'INSERT' THEN 'absent' ELSE 'present' END) AS was, CASE WHEN r.dur THEN CASE WHEN r.ty = 'DELETE' THEN 'absent' ELSE 'present' END ELSE coalesce(last_value(CASE WHEN r.dur THEN CASE WHEN r.ty = 'DELETE' THEN 'absent' ELSE 'present' END END IGNORE NULLS) OVER w, CASE WHEN rl.t0 = 'INSERT' THEN 'absent' ELSE 'present' END) END AS is_ FROM rev r JOIN rl ON rl.case_id = r.case_id AND rl.key = r.key WINDOW w AS (PARTITION BY r.case_id, r.key ORDER BY r.ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) GROUP BY ALL"))(
    lambda a: history.steps(a.correlation.record_events).groupBy("case_id", "pk").agg(F.count_if(F.col("presence_before") != F.col("presence_after")).alias("changes"))
)
query("h11_gap_steps", chain("SELECT " + REC + ", 'log.000007' AS missing_file FROM rl WHERE case_id = 'B'"))(lambda a: rec(history.gap_steps(a.history.presence, a.gaps), "missing_file"))
query("h11_all_steps", chain(STEPS))(lambda a: rec(history.all_steps(a.correlation.record_events, a.correlation.records, a.correlation.aliases, a.gaps), F.col("step").cast("long").alias("step"), "kind", "rule_id", "detail"))
query("h12_lineage", chain("SELECT " + REC + ", CAST(max(ord) FILTER (WHERE dur AND ty <> 'DELETE') AS BIGINT) AS set_at FROM rev GROUP BY ALL HAVING count(*) FILTER (WHERE dur AND ty <> 'DELETE') > 0"))(
    lambda a: rec(a.history.states.filter("column = 'price_cents' and set_by is not null"), (F.substring("set_by.source_file", -1, 1).cast("long") * 10**12 + F.col("set_by.log_position") * 100 + F.col("set_by.row_index")).alias("set_at"))
)
query("h14_gap_touched", chain("SELECT " + REC + ", gap AS gap_touched FROM rm WHERE logged"))(lambda a: rec(a.history.records, "gap_touched"))

# --- reconciliation ---------------------------------------------------------------------------------------------------

query("r01_grid", chain("SELECT " + REC + ", count(*) AS fields FROM fld GROUP BY ALL"))(lambda a: reduce(DataFrame.unionByName, [g.select("case_id", "pk") for g in a.reconciliation.grid]).groupBy("case_id", "pk").agg(F.count("*").alias("fields")))
query("r02_field_verdicts", chain("SELECT " + REC + ", col AS field, rule AS rule_id, res AS result FROM vr WHERE col <> 'presence'"))(lambda a: rec(a.reconciliation.fields.filter("column <> 'presence'"), F.col("column").alias("field"), "rule_id", "result"))
query("r03_presence", chain("SELECT " + REC + ", lp AS log_presence, pp AS phys_presence, rule AS rule_id FROM pre"))(
    lambda a: rec(a.reconciliation.presence, F.col("log_display").alias("log_presence"), F.when(F.col("phys_display") == "unknown", "absent").otherwise(F.col("phys_display")).alias("phys_presence"), "rule_id")
)
query("r06_conflict_explanations", chain("SELECT case_id, pk, rule_id FROM (SELECT f.case_id, CAST(f.key AS VARCHAR) AS pk, CASE WHEN f.psp = f.price THEN 'R-RECON-030' WHEN NOT EXISTS (SELECT 1 FROM rev r WHERE r.case_id = f.case_id AND r.key = f.key AND r.ty <> 'DELETE' AND r.ap = f.price) AND EXISTS (SELECT 1 FROM rev r WHERE r.case_id = f.case_id AND r.key = f.key AND r.ty <> 'DELETE') THEN 'R-RECON-031' END AS rule_id FROM fld f WHERE f.rule = 'R-RECON-003' AND f.col = 'price_cents') WHERE rule_id IS NOT NULL"))(
    lambda a: rec(a.explanations.filter("column = 'price_cents'"), "rule_id")
)
query("r08_roll_up", chain("SELECT " + REC + ", res AS result, rule AS rule_id, n AS fields, compared FROM rolled"))(lambda a: rec(a.reconciliation.records, "result", "rule_id", "fields", "compared"))
query("r09_labels", chain("SELECT case_id, pk, CASE WHEN n = 1 THEN col || ': ' || res ELSE CAST(n AS VARCHAR) || ' fields: ' || res END AS label FROM (SELECT " + REC + ", sev, res, count(*) AS n, min(col) AS col, row_number() OVER (PARTITION BY case_id, key ORDER BY sev DESC) AS rn FROM (SELECT *, CASE res WHEN 'Exact' THEN 0 WHEN 'Strong' THEN 1 WHEN 'Unsupported' THEN 3 WHEN 'Unresolved' THEN 4 ELSE 5 END AS sev FROM vr) GROUP BY case_id, key, sev, res) WHERE rn = 1"))(
    lambda a: rec(a.reconciliation.records, "label")
)
query("r10_triggers", chain("SELECT " + REC + ", string_agg(col || ': ' || res, ',' ORDER BY po) AS triggers FROM vr WHERE res IN ('Conflicting', 'Unresolved') GROUP BY ALL"))(lambda a: rec(a.reconciliation.records.filter("flagged"), F.array_join("triggers", ",").alias("triggers")))
query("r11_verdict_counts", chain("SELECT case_id, res AS result, rule AS rule_id, count(*) AS records FROM rolled GROUP BY ALL"))(lambda a: a.reconciliation.records.groupBy("case_id", "result", "rule_id").agg(F.count("*").alias("records")))
query("r12_field_provenance", chain("SELECT " + REC + ", count(*) AS n FROM rev WHERE ty <> 'DELETE' AND dur GROUP BY ALL"))(
    lambda a: a.history.cells.filter("column = 'price_cents' and durable and event_type <> 'DELETE'").groupBy("case_id", "pk").agg(F.count("*").alias("n"))
)
query("r13_incomplete_coverage", "SELECT 'B' AS case_id, 'R-COV-005' AS rule_id")(lambda a: a.coverage.filter("not complete").select("case_id", F.lit("R-COV-005").alias("rule_id")))

# --- findings, reports ------------------------------------------------------------------------------------------------

query("g01_finding_texts", chain("SELECT case_id, rule_id, subject, severity, title, text FROM (" + FOUND + ") JOIN " + CATALOGUE + " ON id = rule_id"))(
    lambda a: rules.described(a.findings).select("case_id", "rule_id", "subject", "severity", "title", "text")
)
query("g03_finding_groups", chain("SELECT case_id, rule_id, severity, count(*) AS occurrences, count(DISTINCT subject) AS subjects FROM (" + FOUND + ") JOIN " + CATALOGUE + " ON id = rule_id GROUP BY ALL"))(
    lambda a: reports.finding_groups(rules.described(a.findings))
)
query("g02_distinct_findings", chain("SELECT case_id, rule_id, count(*) AS n FROM (SELECT DISTINCT * FROM (" + FOUND + ")) GROUP BY ALL"))(
    lambda a: rules.distinct_findings(a.findings.unionByName(a.findings)).groupBy("case_id", "rule_id").agg(F.count("*").alias("n"))
)
query("g05_exception_groups", chain("SELECT case_id, col AS field, res AS result, rule AS rule_id, count(*) AS occurrences, count(DISTINCT key) AS records FROM vr WHERE res <> 'Exact' GROUP BY ALL"))(lambda a: reports.exception_groups(a.reconciliation.fields))
query("g06_source_ranges", chain("SELECT case_id, 'log.00000' || CAST(f AS VARCHAR) AS source_file, count(*) AS located, min(pos) AS first_position, max(pos) AS last_position FROM ev GROUP BY case_id, f"))(lambda a: reports.source_ranges(a.grouping.events))
query("g07_totals", chain("SELECT c.case_id, r.result, count(v.key) AS fields FROM (SELECT DISTINCT case_id FROM rec) c CROSS JOIN (VALUES ('Exact'), ('Strong'), ('Partial'), ('Unsupported'), ('Unresolved'), ('Conflicting')) r(result) LEFT JOIN vr v ON v.case_id = c.case_id AND v.res = r.result GROUP BY ALL"))(
    lambda a: reports.zero_filled(a.field_verdicts).select("case_id", "result", F.col("n").alias("fields"))
)
query("g08_input_counts", chain("SELECT case_id, ty AS event_type, count(*) AS events FROM ev1 GROUP BY ALL"), "case")(lambda c: c.events.groupBy("case_id", "event_type").agg(F.count("*").alias("events")))
query("g09_transaction_status", chain("SELECT c.case_id, s.status, count(t.tx) AS n FROM (VALUES ('A'), ('B')) c(case_id) CROSS JOIN (VALUES ('committed'), ('rolled_back'), ('incomplete')) s(status) LEFT JOIN (SELECT case_id, tx, st FROM mkn UNION ALL SELECT case_id, 'synthesised', 'incomplete' FROM syn) t ON t.case_id = c.case_id AND t.st = s.status GROUP BY ALL"))(
    lambda a: reports.status_counts(a.grouping.transactions)
)
query("g09_method_counts", chain("SELECT case_id, method, count(*) AS records FROM rm GROUP BY ALL"))(lambda a: a.correlation.found.groupBy("case_id", "method").agg(F.count("*").alias("records")))
query("g11_log_inventory_counts", "SELECT * FROM (VALUES ('A', 6, 6, 0), ('B', 7, 6, 1)) t(case_id, listed, present, missing)", "case")(
    lambda c: c.log_files.groupBy("case_id").agg(F.count("*").alias("listed"), F.count_if(F.col("present")).alias("present"), F.count_if(~F.col("present")).alias("missing"))
)
query("g12_case_preview", chain("SELECT r.case_id, count(*) AS records, count(*) FILTER (WHERE r.res = 'Exact') AS exact, count(*) FILTER (WHERE r.res = 'Unresolved') AS unresolved FROM rolled r GROUP BY ALL"))(
    lambda a: a.reconciliation.records.groupBy("case_id").agg(F.count("*").alias("records"), F.count_if(F.col("result") == "Exact").alias("exact"), F.count_if(F.col("result") == "Unresolved").alias("unresolved"))
)
query("g13_interning", "SELECT sha256(o_orderpriority) AS id, o_orderpriority AS payload, count(*) AS uses FROM orders GROUP BY ALL", "tables")(lambda s, d: reports.intern(s.read.parquet(f"{d}/orders.parquet"), "o_orderpriority")[0])
query("g14_expansion", "SELECT o_orderkey, o_orderpriority FROM orders", "tables")(
    lambda s, d: reports.expand(*reports.intern(s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderpriority"), "o_orderpriority")[::-1], "o_orderpriority").select("o_orderkey", "o_orderpriority")
)
query("g16_export_selection", chain("SELECT r.case_id, count(DISTINCT r.key) AS records, count(DISTINCT r.ord) AS events FROM rev r JOIN rolled v ON v.case_id = r.case_id AND v.key = r.key AND v.res <> 'Exact' GROUP BY ALL"))(
    lambda a: reports.selected_events(a.correlation.record_events, a.record_verdicts).groupBy("case_id").agg(F.countDistinct("pk").alias("records"), F.countDistinct("source_file", "log_position", "row_index").alias("events"))
)
query("g18_pseudonyms", "SELECT s.s_suppkey, 'nation-' || CAST(dense_rank() OVER (ORDER BY n.n_name) AS VARCHAR) AS alias FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey", "tables")(lambda s, d: _aliases(s, d))


def _aliases(s: SparkSession, d: str) -> DataFrame:
    joined = s.read.parquet(f"{d}/supplier.parquet").join(s.read.parquet(f"{d}/nation.parquet"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    return reports.pseudonymise(joined, "n_name", "nation").select("s_suppkey", F.col("n_name").alias("alias"))


# --- serving ----------------------------------------------------------------------------------------------------------

query("v02_history_counts", chain("SELECT case_id, count(*) AS histories FROM rl GROUP BY ALL"))(lambda a: a.history.presence.groupBy("case_id").agg(F.count("*").alias("histories")))
query("v04_steps_with_events", chain("SELECT " + REC + ", ord, ty AS event_type FROM rev WHERE case_id = 'A'"))(
    lambda a: serving.steps_with_events(history.steps(a.correlation.record_events), a.grouping.events).filter("case_id = 'A'").select("case_id", "pk", (F.substring("source_file", -1, 1).cast("long") * 10**12 + F.col("log_position") * 100 + F.col("row_index")).alias("ord"), "event_type")
)
query(
    "v06_flagged_groups",
    "WITH RECURSIVE " + chain("").removeprefix("WITH ") + """, fl AS (SELECT DISTINCT r.case_id, r.key, r.tx FROM rev r JOIN vr v ON v.case_id = r.case_id AND v.key = r.key AND v.res = 'Conflicting' WHERE r.tx IS NOT NULL AND r.f = 6),
lk AS (SELECT DISTINCT a.case_id, a.key AS a, b.key AS b FROM fl a JOIN fl b ON a.case_id = b.case_id AND a.tx = b.tx),
cc AS (SELECT case_id, a AS key, b AS root FROM lk UNION SELECT cc.case_id, cc.key, lk.b FROM cc JOIN lk ON lk.case_id = cc.case_id AND lk.a = cc.root)
SELECT case_id, CAST(key AS VARCHAR) AS pk, min(CAST(root AS VARCHAR)) AS group_id FROM cc GROUP BY ALL""",
)(lambda a: serving.flagged_groups(a.correlation.record_events.filter("source_file = 'log.000006'"), a.field_verdicts.filter("result = 'Conflicting'")).select("case_id", "pk", "group_id"))
query("v07_node_kinds", chain("SELECT " + REC + ", CASE WHEN EXISTS (SELECT 1 FROM vr v WHERE v.case_id = r.case_id AND v.key = r.key AND v.res = 'Conflicting') THEN 'conflicting' WHEN EXISTS (SELECT 1 FROM vr v WHERE v.case_id = r.case_id AND v.key = r.key AND v.res = 'Unresolved') THEN 'unresolved' ELSE 'agreeing' END AS kind FROM rolled r"))(lambda a: rec(serving.node_kinds(a.record_verdicts, a.field_verdicts), "kind"))
query("v08_stage_summaries", chain("SELECT 'events' AS stage, count(*) AS n FROM ev UNION ALL SELECT 'records', count(*) FROM rec UNION ALL SELECT 'verdicts', count(*) FROM rolled"))(
    lambda a: serving.stage_sizes({"events": a.grouping.events, "records": a.correlation.records, "verdicts": a.record_verdicts})
)

SCREEN = (
    "SELECT case_id, 'grouping' AS stage, 'transactions' AS kind, row_number() OVER (PARTITION BY case_id ORDER BY o, s) - 1 AS ordinal, tx AS identity, st AS bucket, CAST(json_object('id', tx, 'status', st, 'source_file', file, 'start_position', s, 'event_count', n) AS VARCHAR) AS summary FROM (SELECT m.case_id, m.tx, m.st, m.file, m.s, m.f AS o, count(c.pos) AS n FROM mkn m LEFT JOIN cl c ON c.case_id = m.case_id AND c.mh = m.h GROUP BY ALL UNION ALL SELECT case_id, 'TX-SYNTH-00000' || CAST(f AS VARCHAR) || '@' || CAST(s AS VARCHAR), 'incomplete', 'log.00000' || CAST(f AS VARCHAR), s, 0, n FROM syn)"
    " UNION ALL SELECT case_id, 'reconstruction', 'history_steps', step, CAST(step AS VARCHAR), CAST(json_array('orders', 'orders:' || pk) AS VARCHAR), CAST(json_object('kind', kind, 'rule_id', rule_id, 'detail', detail) AS VARCHAR) FROM (" + STEPS + ")"
    " UNION ALL SELECT case_id, 'reconciliation', 'comparisons', row_number() OVER (PARTITION BY case_id ORDER BY key, col) - 1, 'orders:' || CAST(key AS VARCHAR), col, CAST(json_object('record_id', 'orders:' || CAST(key AS VARCHAR), 'field', col, 'result', res, 'rule_id', rule) AS VARCHAR) FROM vr"
    " UNION ALL SELECT case_id, 'reconciliation', 'reconciliation', row_number() OVER (PARTITION BY case_id ORDER BY key) - 1, 'orders:' || CAST(key AS VARCHAR), res, CAST(json_object('record_id', 'orders:' || CAST(key AS VARCHAR), 'result', res, 'rule_id', rule, 'field_count', n) AS VARCHAR) FROM rolled"
)
query("v01_screen_index", chain(SCREEN))(
    lambda a: serving.screen_index(a.grouping.transactions, history.all_steps(a.correlation.record_events, a.correlation.records, a.correlation.aliases, a.gaps), a.field_verdicts, a.record_verdicts).drop("detail")
)

# --- quality ----------------------------------------------------------------------------------------------------------

query("q01_multiset_match", "SELECT (SELECT count(*) FROM (SELECT l_suppkey FROM lineitem INTERSECT ALL SELECT l_partkey FROM lineitem)) AS matched", "tables")(
    lambda s, d: quality.multiset_match(*(s.read.parquet(f"{d}/lineitem.parquet").select(F.col(c).alias("k")) for c in ("l_suppkey", "l_partkey")))
)
query("q02_scorecard", chain("SELECT count(*) AS fields, count(*) FILTER (WHERE res IN ('Exact', 'Strong')) AS right_, count(*) FILTER (WHERE res = 'Conflicting') AS false_alarms, count(*) FILTER (WHERE res = 'Unresolved') AS inconclusive FROM vr"))(lambda a: quality.scorecard(a.reconciliation.fields))
query("q06_line_totals", "SELECT o.o_orderkey, count(*) AS lines FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey HAVING abs(max(o.o_totalprice) - sum(l.l_extendedprice)) > 1", "tables")(
    lambda s, d: quality.header_line_mismatch(s.read.parquet(f"{d}/orders.parquet"), s.read.parquet(f"{d}/lineitem.parquet"))
)
query("q06_dangling_lines", "SELECT count(*) AS n FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey)", "tables")(
    lambda s, d: quality.dangling(s.read.parquet(f"{d}/lineitem.parquet"), s.read.parquet(f"{d}/orders.parquet"), "l_orderkey", "o_orderkey").agg(F.count("*").alias("n"))
)
query("q08_conservation", chain("SELECT count(*) AS events, count(*) AS accounted FROM ev"))(lambda a: quality.conservation(a.grouping.events, a.grouping.tx_events, a.grouping.orphans))
query("q09_profile", chain("SELECT case_id, count(*) AS events, count(DISTINCT f * 1000000000000 + pos) AS positions FROM ev GROUP BY ALL"))(lambda a: quality.profile(a.grouping.events))

# --- more functions, listings and reports over the driver's tables ------------------------------------------------------


def read(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


query("f01_base_type", "SELECT o_orderkey, lower(regexp_extract(o_orderpriority || 'High(3)', '([A-Za-z]+)', 1)) AS base FROM orders", "tables")(
    lambda s, d: read(s, d, "orders").select("o_orderkey", values.base_type(F.regexp_replace(F.concat("o_orderpriority", F.lit("High(3)")), "^[^A-Za-z]*", " ")).alias("base"))
)
query("f03_compare", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) = l_linenumber AS equal FROM lineitem", "tables")(
    lambda s, d: values.compared(read(s, d, "lineitem").select("l_orderkey", "l_linenumber", values.value("int", F.col("l_quantity").cast("long")).alias("a"), values.value("str", F.concat(F.lit("0"), F.col("l_linenumber").cast("string"), F.lit(".00"))).alias("b")), "a", "b").select("l_orderkey", "l_linenumber", F.col("c.equal").alias("equal"))
)
query("f04_render", "SELECT event_id, CASE WHEN event_type = 'view' THEN 'NULL' WHEN event_type = 'click' THEN 'undecodable (' || event_type || ')' ELSE event_type END AS shown FROM events", "tables")(
    lambda s, d: read(s, d, "events").select("event_id", values.render(F.when(F.col("event_type") == "click", values.value("undecodable", F.col("event_type"))).otherwise(values.of(F.when(F.col("event_type") != "view", F.col("event_type")), "str"))).alias("shown"))
)
query("f07_separator_collisions", "SELECT c_custkey FROM customer WHERE contains(c_name || CASE WHEN c_custkey % 7 = 0 THEN '|x' ELSE '' END, '|')", "tables")(
    lambda s, d: read(s, d, "customer").filter(values.separator_collides(F.array(F.col("c_custkey").cast("string"), F.concat("c_name", F.when(F.col("c_custkey") % 7 == 0, "|x").otherwise(""))))).select("c_custkey")
)
query("f08_basename", "SELECT c_custkey, c_name AS base FROM customer", "tables")(lambda s, d: read(s, d, "customer").select("c_custkey", values.basename(F.concat(F.lit("/var\\log/"), "c_name")).alias("base")))
query("f10_canonical_json", """SELECT c_custkey, '{"a":"' || c_mktsegment || '","b":"' || c_name || '"}' AS json FROM customer""", "tables")(
    lambda s, d: read(s, d, "customer").select("c_custkey", values.canonical_map(F.create_map(F.lit("b"), "c_name", F.lit("a"), "c_mktsegment")).alias("json"))
)
query("f12_rule_text", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name || ' is in ' || c_mktsegment ELSE '{name} is in {segment}' END AS said FROM customer", "tables")(
    lambda s, d: read(s, d, "customer").select("c_custkey", values.rule_text(F.lit("{name} is in {segment}"), F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("name"), "c_name", F.lit("segment"), "c_mktsegment")).otherwise(F.create_map(F.lit("name"), "c_name"))).alias("said"))
)
query("f14_utc_text", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS at_utc FROM orders", "tables")(lambda s, d: read(s, d, "orders").select("o_orderkey", values.utc_text(F.col("o_orderdate")).alias("at_utc")))
query("s10_literals", "SELECT c_custkey, 'str' AS kind, c_name AS text FROM customer UNION ALL SELECT c_custkey, 'int', CAST(c_custkey AS VARCHAR) FROM customer", "tables")(
    lambda s, d: read(s, d, "customer").select("c_custkey", F.explode(F.array(values.literal(F.concat(F.lit("'"), "c_name", F.lit("'")), "log"), values.literal(F.col("c_custkey").cast("string"), "snapshot"))).alias("v")).select("c_custkey", "v.kind", "v.text")
)
query("s22_export_json", """SELECT '{"c_custkey":' || CAST(c_custkey AS VARCHAR) || ',"c_name":"' || c_name || '"}' AS json FROM customer""", "tables")(lambda s, d: reports.export_json(read(s, d, "customer").select("c_name", "c_custkey")))
query("o01_file_sequence", "SELECT 'A' AS case_id, 'log.00000' || CAST(i AS VARCHAR) AS file, i AS file_seq FROM range(1, 7) t(i) UNION ALL SELECT 'B', 'log.00000' || CAST(i AS VARCHAR), i FROM range(1, 8) t(i)", "case")(lambda c: ordering.file_sequence(c.log_files).select("case_id", "file", F.col("file_seq").cast("long").alias("file_seq")))
query("o07_latest_runs", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100", "tables")(lambda s, d: scope.latest_runs(read(s, d, "orders"), ["o_orderdate", "o_orderkey"]).select("o_orderkey"))
query("p09_latest_version", "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey", "tables")(lambda s, d: scope.latest_version(read(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey"))
query("t15_missing_provenance", chain("SELECT DISTINCT case_id, 'log.00000' || CAST(f AS VARCHAR) AS source_file FROM ev WHERE f <> 4"), "case")(
    lambda c: transactions.missing_provenance(c.events, c.events.filter("source_file = 'log.000004'")).select("case_id", "source_file")
)
query("c16_shared_table_names", 'SELECT CAST(k AS VARCHAR) AS "table" FROM (SELECT DISTINCT c_nationkey AS k FROM customer) JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier) USING (k)', "tables")(
    lambda s, d: identity.shared_table_names(read(s, d, "customer").select(F.lit("A").alias("case_id"), F.lit("x").alias("database"), F.col("c_nationkey").cast("string").alias("table")).union(read(s, d, "supplier").select(F.lit("A"), F.lit("y"), F.col("s_nationkey").cast("string")))).select("table")
)
query("r04_absence_inferred", chain("SELECT " + REC + " FROM pre WHERE NOT logged AND lp = 'absent'"))(lambda a: rec(a.field_verdicts.filter("column = 'presence' and log_display = 'absent'").join(a.correlation.records.filter("n_events = 0").select(*identity.RECORD), identity.RECORD, "left_semi")))
query("r05_snapshot_absence", chain("SELECT " + REC + " FROM pre WHERE so IS NULL"))(lambda a: rec(a.field_verdicts.filter("column = 'presence' and phys_display = 'absent'").join(a.correlation.records.filter("snapshot_ord is null").select(*identity.RECORD), identity.RECORD, "left_semi")))
query("r07_unsupported_tables", "SELECT 'A' AS case_id, 'nation' AS \"table\", 'Unsupported' AS result, 'R-CORR-020' AS rule_id UNION ALL SELECT 'A', 'region', 'Unsupported', 'R-CORR-021'", "tables")(
    lambda s, d: reconcile.unsupported_tables(_gate(s, d).withColumn("database", F.lit("main"))).select("case_id", "table", "result", "rule_id")
)
query("g04_warning_groups", "SELECT event_type AS code, CAST(user_id % 10 AS VARCHAR) AS evidence, count(*) AS entries FROM events GROUP BY ALL", "tables")(lambda s, d: reports.warning_groups(read(s, d, "events").withColumn("e", F.col("user_id") % 10), "event_type", "e"))
query("g10_processing_summary", "SELECT o_orderpriority, o_orderstatus, min(o_orderkey) AS first_run, max(o_orderkey) AS last_run, count(DISTINCT o_custkey) AS runs FROM orders GROUP BY ALL", "tables")(lambda s, d: reports.processing_summary(read(s, d, "orders"), ["o_orderpriority", "o_orderstatus"], "o_custkey", "o_orderkey"))
query("g17_catalog_summary", "SELECT * FROM (VALUES ('A', 5, 'o_orderkey'), ('B', 5, 'o_orderkey')) t(case_id, columns, key)", "case")(lambda c: reports.catalog_summary(c.catalog).select("case_id", "columns", "key"))
query("g19_coverage_summary", "SELECT * FROM (VALUES ('A', true, ''), ('B', false, 'log.000007')) t(case_id, complete, missing_files)")(lambda a: reports.coverage_summary(a.coverage, a.gaps))
query("v03_detail", chain("SELECT " + REC + ", res AS result FROM rolled WHERE key % 97 = 0"))(lambda a: rec(serving.detail(a.record_verdicts.filter("cast(pk as bigint) % 97 = 0"), identity.RECORD), "result"))
query("v05_json_members", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events", "tables")(lambda s, d: serving.json_members(read(s, d, "events"), "props", "k long").select("event_id", "k"))
query("v09_fresh_results", "SELECT o.o_orderkey FROM orders o JOIN (SELECT o_custkey, max(o_orderkey) AS k FROM orders GROUP BY o_custkey) m ON m.o_custkey = o.o_custkey AND m.k = o.o_orderkey", "tables")(
    lambda s, d: serving.fresh(read(s, d, "orders").withColumn("run_id", F.col("o_orderkey")), read(s, d, "orders").select("o_custkey", F.col("o_orderkey").alias("run_id")), ["o_custkey"]).select("o_orderkey")
)
query("q03_accuracy", "SELECT count(*) FILTER (WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0) AS right_, count(*) FILTER (WHERE o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0) AS wrong, count(*) FILTER (WHERE o_orderkey % 5 = 0) AS missing, 0 AS unexpected FROM orders", "tables")(
    lambda s, d: quality.accuracy(read(s, d, "orders"), read(s, d, "orders").filter("o_orderkey % 5 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, "?").otherwise(F.col("o_orderstatus"))), ["o_orderkey"], "o_orderstatus")
)
query("q04_repeatability", "SELECT count(*) AS rows, true AS same FROM orders", "tables")(lambda s, d: quality.same_result(read(s, d, "orders"), read(s, d, "orders").repartition(5)))
query("q05_provenance_coverage", chain("SELECT count(*) AS observed, count(*) FILTER (WHERE set_) AS linked FROM (SELECT key, pd IS NOT NULL AS seen, EXISTS (SELECT 1 FROM rev v WHERE v.case_id = r.case_id AND v.key = r.key AND v.dur AND v.ty <> 'DELETE') AS set_ FROM rec r WHERE logged) WHERE seen"))(lambda a: quality.provenance_coverage(a.history.states.filter("column = 'price_cents'")))
query("q07_manifest_counts", "SELECT o_orderstatus, count(*) + 1 AS want, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL", "tables")(
    lambda s, d: quality.count_mismatch(*(lambda c: (c, c.withColumn("n", F.col("n") + (F.col("o_orderstatus") == "F").cast("long"))))(read(s, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))), ["o_orderstatus"])
)
query("g15_ordered_pool", "SELECT row_number() OVER (ORDER BY sha256(c_name)) - 1 AS ordinal, sha256(c_name) AS id, c_name AS payload FROM (SELECT DISTINCT c_name FROM customer)", "tables")(lambda s, d: reports.ordered_pool(read(s, d, "customer"), "c_name"))
query("s21_value_codec", "SELECT o_orderkey, o_orderpriority AS prio, CAST(o_custkey AS VARCHAR) AS cust FROM orders", "tables")(
    lambda s, d: read(s, d, "orders").select("o_orderkey", F.from_json(F.to_json(F.create_map(F.lit("p"), values.value("str", F.col("o_orderpriority")), F.lit("c"), values.value("int", F.col("o_custkey")))), values.IMAGE).alias("m")).select("o_orderkey", F.col("m")["p"]["text"].alias("prio"), F.col("m")["c"]["text"].alias("cust"))
)
query("p06_normalised_values", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'mid' WHEN 2 THEN 'high' ELSE CAST(o_orderkey % 4 + 1 AS VARCHAR) END AS label FROM orders", "tables")(
    lambda s, d: read(s, d, "orders").select("o_orderkey", text.normalise(values.value("int", F.col("o_orderkey") % 4 + 1), F.lit("enum('low','mid','high')"))["text"].alias("label"))
)
query("f09_codepoint_order", "SELECT c_custkey, row_number() OVER (ORDER BY c_name, c_custkey) AS place FROM customer WHERE c_custkey % 2 = 0", "tables")(
    lambda s, d: ordering.ranked(read(s, d, "customer").filter("c_custkey % 2 = 0").withColumn("case_id", F.lit("A")), [F.col("c_name"), F.col("c_custkey")]).select("c_custkey", (F.col("ordinal") + 1).alias("place"))
)


# --- whole tables: operators whose queries above take a part of the rows, or lists of fixed length --------------------

query("v03_detail_whole", chain("SELECT " + REC + ", res AS result FROM rolled"))(lambda a: rec(serving.detail(a.record_verdicts, identity.RECORD), "result"))
query("f09_codepoint_order_whole", "SELECT c_custkey, row_number() OVER (ORDER BY c_name, c_custkey) AS place FROM customer", "tables")(
    lambda s, d: ordering.ranked(read(s, d, "customer").withColumn("case_id", F.lit("A")), [F.col("c_name"), F.col("c_custkey")]).select("c_custkey", (F.col("ordinal") + 1).alias("place"))
)
query("v04_steps_with_events_whole", chain("SELECT " + REC + ", ord, ty AS event_type FROM rev"))(
    lambda a: serving.steps_with_events(history.steps(a.correlation.record_events), a.grouping.events).select("case_id", "pk", (F.substring("source_file", -1, 1).cast("long") * 10**12 + F.col("log_position") * 100 + F.col("row_index")).alias("ord"), "event_type")
)
query(
    "v06_flagged_groups_whole",
    "WITH RECURSIVE " + chain("").removeprefix("WITH ") + """, fl AS MATERIALIZED (SELECT DISTINCT r.case_id, r.key, r.tx FROM rev r JOIN vr v ON v.case_id = r.case_id AND v.key = r.key AND v.res = 'Conflicting' WHERE r.tx IS NOT NULL),
st AS MATERIALIZED (SELECT DISTINCT f.case_id, f.key, f.tx, min(f.key) OVER (PARTITION BY f.case_id, f.tx) AS hub FROM fl f),
lk AS MATERIALIZED (SELECT DISTINCT case_id, key AS a, hub AS b FROM st UNION SELECT DISTINCT case_id, hub, key FROM st),
cc AS (SELECT case_id, a AS key, b AS root FROM lk UNION SELECT cc.case_id, cc.key, lk.b FROM cc JOIN lk ON lk.case_id = cc.case_id AND lk.a = cc.root)
SELECT case_id, CAST(key AS VARCHAR) AS pk, min(CAST(root AS VARCHAR)) AS group_id FROM cc GROUP BY ALL""",
)(lambda a: serving.flagged_groups(a.correlation.record_events, a.field_verdicts.filter("result = 'Conflicting'")).select("case_id", "pk", "group_id"))
query("p08_rows_at_position_whole", chain("SELECT case_id, 'log.00000' || CAST(f AS VARCHAR) AS source_file, pos AS log_position, count(*) AS n FROM ev GROUP BY ALL HAVING count(*) > 1"), "case")(
    lambda c: transactions.deduplicate(c.events)[0].groupBy("case_id", "source_file", "log_position").agg(F.count("*").alias("n")).filter("n > 1")
)


def _log_lists(s: SparkSession, d: str) -> DataFrame:
    """A server's log list for each customer: two lines of items share a file, so files are listed twice."""
    return read(s, d, "lineitem").join(read(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(
        "cast(o_custkey as string) as case_id", "cast(l_orderkey * 10 + l_linenumber as int) as seq", "concat('/var/log/log.', l_orderkey, '-', l_linenumber div 2) as file", "l_orderkey % 3 <> 0 as present"
    )


def _catalogs(s: SparkSession, d: str) -> DataFrame:
    """A catalog for each order: its items are columns, the first is the key."""
    return read(s, d, "lineitem").selectExpr(
        "cast(l_orderkey as string) as case_id", "'shop' as database", "'items' as table", "concat('c', l_linenumber) as column", "cast(l_linenumber as int) as position", "'int' as data_type", "l_linenumber = 1 as is_primary_key"
    )


LISTS = "WITH ll AS (SELECT CAST(o_custkey AS VARCHAR) AS case_id, l_orderkey * 10 + l_linenumber AS seq, 'log.' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber // 2 AS VARCHAR) AS file, l_orderkey % 3 <> 0 AS present FROM lineitem JOIN orders ON l_orderkey = o_orderkey) "
query("s14_log_inventory_whole", LISTS + "SELECT case_id, file FROM ll WHERE NOT present", "tables")(lambda s, d: _log_lists(s, d).filter("not present").select("case_id", values.basename(F.col("file")).alias("file")))
query("g11_log_inventory_counts_whole", LISTS + "SELECT case_id, count(*) AS listed, count(*) FILTER (WHERE present) AS present, count(*) FILTER (WHERE NOT present) AS missing FROM ll GROUP BY case_id", "tables")(
    lambda s, d: _log_lists(s, d).groupBy("case_id").agg(F.count("*").alias("listed"), F.count_if(F.col("present")).alias("present"), F.count_if(~F.col("present")).alias("missing"))
)
query("o01_file_sequence_whole", LISTS + "SELECT case_id, file, min(seq) AS file_seq FROM ll GROUP BY ALL", "tables")(lambda s, d: ordering.file_sequence(_log_lists(s, d)).select("case_id", "file", F.col("file_seq").cast("long").alias("file_seq")))
query("g17_catalog_summary_whole", "SELECT CAST(l_orderkey AS VARCHAR) AS case_id, count(*) AS columns, coalesce(string_agg('c1', ',') FILTER (WHERE l_linenumber = 1), '') AS key FROM lineitem GROUP BY l_orderkey", "tables")(lambda s, d: reports.catalog_summary(_catalogs(s, d)).select("case_id", "columns", "key"))


# --- situations that the derived log does not hold by itself -----------------------------------------------------------

query("t04_unlisted_in_range_shortened", chain("SELECT m.case_id, m.file AS source_file, m.s AS start_position, e.pos AS log_position, e.ri AS row_index FROM mkn m JOIN ev e ON e.case_id = m.case_id AND e.f = m.f AND e.pos BETWEEN m.s AND m.e WHERE NOT m.ses AND (e.h <> m.h OR e.pos % 700 = 0) AND EXISTS (SELECT 1 FROM ev x WHERE x.case_id = m.case_id AND x.h = m.h AND x.pos % 700 <> 0)"), "case")(
    lambda c: transactions.unlisted_in_range(transactions.deduplicate(c.events)[0], c.markers.withColumn("event_positions", F.filter("event_positions", lambda p: p % 700 != 0))).select("case_id", "source_file", "start_position", "log_position", F.col("row_index").cast("long").alias("row_index"))
)
query("c08_reused_after_delete_again", chain("SELECT DISTINCT " + REC + " FROM rev WHERE ty = 'DELETE' AND pos % 200 = 0"))(
    lambda a: rec(identity.reused_after_delete(a.correlation.record_events.unionByName(_inserted_again(a.correlation.record_events))))
)


def _inserted_again(of_record: DataFrame) -> DataFrame:
    """An INSERT after each deletion at an even hundred, and one before each other deletion."""
    later = F.when(F.col("log_position") % 200 == 0, 1).otherwise(-1)
    return of_record.filter("event_type = 'DELETE'").withColumn("ord", F.struct(F.col("ord.seq").alias("seq"), F.col("ord.name").alias("name"), (F.col("ord.position") + later).alias("position"), F.col("ord.row").alias("row"))).withColumn("event_type", F.lit("INSERT"))


from . import review_queries  # noqa: E402, F401  registers its queries
