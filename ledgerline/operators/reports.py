"""Aggregates and exports over findings and verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import basename, digest
from .identity import RECORD
from .provenance import as_of
from .reconcile import SEVERITY


def finding_groups(findings: DataFrame) -> DataFrame:
    """Described findings by rule: how severe, how often, about how many subjects."""
    return findings.groupBy("case_id", "rule_id", "severity").agg(F.count("*").alias("occurrences"), F.countDistinct("subject").alias("subjects"))


def exception_groups(field_verdicts: DataFrame) -> DataFrame:
    return field_verdicts.filter("result <> 'Exact'").groupBy("case_id", F.col("column").alias("field"), "result", "rule_id").agg(F.count("*").alias("occurrences"), F.countDistinct("pk").alias("records"))


def source_ranges(events: DataFrame) -> DataFrame:
    return events.groupBy("case_id", "source_file").agg(F.count("*").alias("located"), F.min("log_position").alias("first_position"), F.max("log_position").alias("last_position"))


def zero_filled(verdicts: DataFrame) -> DataFrame:
    """Counts for every case and each of the six verdicts, zero where there is none."""
    counts = verdicts.groupBy("case_id", "result").agg(F.count("*").alias("n"))
    every = verdicts.select("case_id").distinct().select("case_id", F.explode(F.array(*[F.lit(s) for s in SEVERITY])).alias("result"))
    return every.join(counts, ["case_id", "result"], "left").fillna({"n": 0})


def status_counts(transactions: DataFrame) -> DataFrame:
    counts = transactions.groupBy("case_id", "status").agg(F.count("*").alias("n"))
    every = transactions.select("case_id").distinct().select("case_id", F.explode(F.array(*[F.lit(s) for s in ("committed", "rolled_back", "incomplete")])).alias("status"))
    return every.join(counts, ["case_id", "status"], "left").fillna({"n": 0})


def intern(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(pool, referring): each distinct value once under its digest with its uses, and df with digests in its place."""
    named = df.withColumn("id", digest(F.col(column).cast("string")))
    pool = named.groupBy("id", F.col(column).alias("payload")).agg(F.count("*").alias("uses"))
    return pool, named.withColumn(column, F.col("id")).drop("id")


def expand(referring: DataFrame, pool: DataFrame, column: str) -> DataFrame:
    """Put values back; a reference that the pool lacks is an error."""
    joined = referring.join(pool.select(F.col("id").alias(column), "payload"), column, "left")
    value = F.when(F.col(column).isNotNull() & F.col("payload").isNull(), F.raise_error(F.lit("invalid reference"))).otherwise(F.col("payload"))
    return joined.withColumn(column, value).drop("payload")


def selected_events(record_events: DataFrame, record_verdicts: DataFrame) -> DataFrame:
    """Events of records whose verdict is not Exact."""
    return record_events.join(record_verdicts.filter("result <> 'Exact'").select(*RECORD), RECORD, "left_semi")


def pseudonymise(df: DataFrame, column: str, category: str) -> DataFrame:
    """df with each distinct value replaced by <category>-<n>, n by order of value; null stays null.

    Values are numbered within hash-free ranges: range partitions are counted first, so no single task ranks them all.
    """
    names = df.select(F.col(column).alias("v")).filter("v is not null").distinct().repartitionByRange("v").withColumn("p", F.spark_partition_id())
    ranked = names.withColumn("n", F.row_number().over(Window.partitionBy("p").orderBy("v")))
    sizes = ranked.groupBy("p").agg(F.max("n").alias("size"))
    before = sizes.select("p", (F.sum("size").over(Window.orderBy("p")) - F.col("size")).alias("before"))
    aliases = ranked.join(before, "p").select("v", F.concat(F.lit(f"{category}-"), (F.col("before") + F.col("n")).cast("string")).alias("alias_"))
    return df.join(aliases, df[column] == aliases["v"], "left").withColumn(column, F.col("alias_")).drop("alias_", "v")


def warning_groups(warnings: DataFrame, code: str, evidence: str) -> DataFrame:
    """Warnings by code and evidence, a missing one being the empty text."""
    return warnings.groupBy(F.coalesce(F.col(code), F.lit("")).alias("code"), F.coalesce(F.col(evidence).cast("string"), F.lit("")).alias("evidence")).agg(F.count("*").alias("entries"))


def processing_summary(runs: DataFrame, by: list[str], run: str, time: str) -> DataFrame:
    return runs.groupBy(*by).agg(F.min(time).alias("first_run"), F.max(time).alias("last_run"), F.countDistinct(run).alias("runs"))


def catalog_summary(catalog: DataFrame) -> DataFrame:
    """Columns and key of each table."""
    key = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("is_primary_key"), F.struct("position", "column")))), lambda s: s["column"]), ",")
    return catalog.groupBy("case_id", "database", "table").agg(F.count("*").alias("columns"), key.alias("key"))


def coverage_summary(coverage: DataFrame, gaps: DataFrame) -> DataFrame:
    """One row per case: complete or not, with the missing files."""
    files = gaps.groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_set("missing_file")), ",").alias("missing_files"))
    return coverage.join(files, "case_id", "left").select("case_id", "complete", F.coalesce("missing_files", F.lit("")).alias("missing_files"))


def export_json(df: DataFrame) -> DataFrame:
    """Each row as JSON with its keys in order."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("json"))


def ordered_pool(df: DataFrame, column: str) -> DataFrame:
    """Each distinct value once with its place in order of digest, from 0.

    Places come from counts per leading digest byte (256 rows) and a rank within it, so no single task ranks them all.
    """
    names = df.select(F.col(column).alias("payload")).filter("payload is not null").distinct().withColumn("id", digest(F.col("payload").cast("string"))).withColumn("p", F.substring("id", 1, 2))
    ranked = names.withColumn("n", F.row_number().over(Window.partitionBy("p").orderBy("id")))
    sizes = ranked.groupBy("p").agg(F.max("n").alias("size"))
    before = sizes.select("p", (F.sum("size").over(Window.orderBy("p")) - F.col("size")).alias("before"))
    return ranked.join(before, "p").select((F.col("before") + F.col("n") - 1).cast("long").alias("ordinal"), "id", "payload")


#: Severities as they are listed, the gravest first.
RANKS = ("warning", "notice", "info")


def ranked_groups(findings: DataFrame, decoded: DataFrame) -> DataFrame:
    """(case_id, rule_id, severity, rank, occurrences, subjects, runs): described findings by rule and severity, with the runs that
    decoded the files their context names.

    decoded: provenance.run_of(runs). A group's runs are few, as a file was decoded a few times.
    """
    held = lambda key: F.when(F.col("context")[key] != "", F.col("context")[key])
    run = as_of(F.col("decoded"), F.coalesce(held("log_position").cast("long"), F.lit(0)))
    placed = findings.withColumn("file", basename(held("source_file"))).join(decoded, ["case_id", "file"], "left").withColumn("run_", run)
    rank = F.array_position(F.array(*[F.lit(x) for x in RANKS]), F.col("severity")).cast("int")
    return placed.groupBy("case_id", "rule_id", "severity").agg(rank.alias("rank"), F.count("*").alias("occurrences"), F.countDistinct("subject").alias("subjects"), F.array_join(F.array_sort(F.collect_set("run_")), ", ").alias("runs"))


def history_counts(records: DataFrame) -> DataFrame:
    """(case_id, database, table, histories, contradicted, partial) of reconstructed records."""
    return records.groupBy("case_id", "database", "table").agg(F.count("*").alias("histories"), F.count_if("contradicted").alias("contradicted"), F.count_if(F.size("partial") > 0).alias("partial"))


def case_preview(catalog: DataFrame, health: DataFrame, log_files: DataFrame, transactions: DataFrame, records: DataFrame) -> DataFrame:
    """One row for each case: what it holds and how it came out. Each table is one aggregate; they meet on case_id.
    records: one verdict each with the counts of its fields."""
    agg = lambda df, *what: df.groupBy("case_id").agg(*what)
    parts = [
        agg(catalog, F.countDistinct("database", "table").alias("tables"), F.count("*").alias("columns")),
        agg(health, F.count_if(F.col("status") == "valid").alias("verified"), F.sum("total_pages").alias("pages"), F.sum("damaged_pages").alias("damaged")),
        agg(log_files, F.count_if(~F.col("present")).alias("missing_logs")),
        agg(transactions, F.count("*").alias("transactions")),
        agg(records, F.count("*").alias("records"), F.sum("n_exact").alias("exact"), F.sum("n_unresolved").alias("unresolved")),
    ]
    return reduce(lambda a, b: a.join(b, "case_id", "full_outer"), parts).na.fill(0)


def listings(snapshot: DataFrame, transactions: DataFrame, health: DataFrame, findings: DataFrame) -> DataFrame:
    """(case_id, listing, bucket, identity): deleted rows by table, incomplete transactions by reason, damaged tables by
    status, findings by rule."""
    table = F.concat_ws(".", "database", "table")
    part = lambda df, name, bucket, identity: df.select("case_id", F.lit(name).alias("listing"), bucket.alias("bucket"), identity.cast("string").alias("identity"))
    return (
        part(snapshot.filter("is_deleted"), "deleted", table, F.col("snapshot_ord"))
        .unionByName(part(transactions.filter("status = 'incomplete'"), "incomplete", F.col("reason"), F.col("tx_id")))
        .unionByName(part(health.filter("status <> 'valid'"), "damaged", F.col("status"), table))
        .unionByName(part(findings, "finding", F.col("rule_id"), F.col("subject")))
    )


def unselected_catalogs(catalog: DataFrame, selected: DataFrame) -> DataFrame:
    """catalog_summary of the tables that selected (case_id, database, table) does not name."""
    return catalog_summary(catalog.join(selected.select("case_id", "database", "table").distinct(), ["case_id", "database", "table"], "left_anti"))
