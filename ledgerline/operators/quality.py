"""Checks of inputs and scores of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import repeated_references  # noqa: F401


def multiset_match(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows that stand in both, as often as they stand in both."""
    return expected.intersectAll(actual).agg(F.count("*").alias("matched"))


def scorecard(field_verdicts: DataFrame) -> DataFrame:
    """Field verdicts of a case that should agree: right, false alarms, inconclusive."""
    return field_verdicts.agg(F.count("*").alias("fields"), F.count_if(F.col("result").isin("Exact", "Strong")).alias("right_"), F.count_if(F.col("result") == "Conflicting").alias("false_alarms"), F.count_if(F.col("result") == "Unresolved").alias("inconclusive"))


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-free digest of a result: rows and the sum of their hashes."""
    return df.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("digest"))


def dangling(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return child.join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def header_line_mismatch(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Headers whose total is not the sum of their lines."""
    sums = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("sum_"), F.count("*").alias("lines"))
    return orders.join(sums, "o_orderkey").filter(F.abs(F.col("o_totalprice") - F.col("sum_")) > 1).select("o_orderkey", "lines")


def conservation(events: DataFrame, tx_events: DataFrame, orphans: DataFrame) -> DataFrame:
    """Every event is in a transaction or an orphan."""
    ref = ["case_id", "source_file", "log_position", "row_index"]
    accounted = tx_events.select(*ref).union(orphans.select(*ref)).distinct()
    return events.agg(F.count("*").alias("events")).crossJoin(accounted.agg(F.count("*").alias("accounted")))


def profile(events: DataFrame) -> DataFrame:
    return events.groupBy("case_id").agg(F.count("*").alias("events"), F.countDistinct("source_file", "log_position").alias("positions"))


def accuracy(expected: DataFrame, actual: DataFrame, keys: list[str], of: str) -> DataFrame:
    """Expected against actual by key: right, wrong, missing and unexpected."""
    both = expected.select(*keys, F.col(of).alias("want_"), F.lit(True).alias("e_")).join(actual.select(*keys, F.col(of).alias("got_"), F.lit(True).alias("a_")), keys, "full_outer")
    right = F.coalesce(F.col("want_").eqNullSafe(F.col("got_")), F.lit(False)) & F.col("e_").isNotNull() & F.col("a_").isNotNull()
    return both.agg(F.count_if(right).alias("right_"), F.count_if(~right & F.col("e_").isNotNull() & F.col("a_").isNotNull()).alias("wrong"), F.count_if(F.col("a_").isNull()).alias("missing"), F.count_if(F.col("e_").isNull()).alias("unexpected"))


def same_result(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whether two runs gave the same rows, by their order-free fingerprints."""
    x, y = fingerprint(a), fingerprint(b).withColumnsRenamed({"rows": "rows_b", "digest": "digest_b"})
    return x.crossJoin(y).select("rows", ((F.col("rows") == F.col("rows_b")) & F.col("digest").eqNullSafe(F.col("digest_b"))).alias("same"))


def provenance_coverage(states: DataFrame) -> DataFrame:
    """Logged values that name the event which set them."""
    return states.filter("durable is not null").agg(F.count("*").alias("observed"), F.count_if(F.col("set_by").isNotNull()).alias("linked"))


def count_mismatch(counted: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Row counts that differ from a manifest's."""
    return expected.withColumnRenamed("n", "want").join(counted, keys, "full_outer").filter(~F.col("n").eqNullSafe(F.col("want"))).select(*keys, "want", "n")


def scored(expected: DataFrame, field_verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Verdicts against what is allowed for each field: one row of counts.

    expected: (keys, allowed array). A field without a verdict counts as missing and in nothing else. A false alarm is a
    conflict that is not allowed, a missed one the only allowed answer not given; inconclusive is Unresolved where only
    agreement is allowed, wrongly unsupported is Unsupported where that is not allowed.
    """
    met = expected.join(field_verdicts.select(*keys, "result"), keys, "left")
    given, may = F.col("result"), lambda x: F.array_contains("allowed", x)
    only = (F.size("allowed") == 1) & may("Conflicting")
    agreeing = F.size(F.array_except("allowed", F.array(F.lit("Exact"), F.lit("Strong")))) == 0
    n = lambda cond, name: F.count_if(F.coalesce(cond, F.lit(False))).alias(name)
    return met.agg(
        F.count("*").alias("expected"), n(given.isNull(), "missing"), n(F.array_contains("allowed", given), "right_"), n((given == "Conflicting") & ~may("Conflicting"), "false_alarms"), n(only, "conflicts_expected"),
        n(only & given.isNotNull() & (given != "Conflicting"), "missed_conflicts"), n((given == "Unresolved") & agreeing, "inconclusive"), n((given == "Unsupported") & ~may("Unsupported"), "wrongly_unsupported"),
    )


def profiles(events: DataFrame, markers: DataFrame, findings: DataFrame) -> DataFrame:
    """(case_id, section, value, n): events, distinct positions, markers by status, findings by severity."""
    count = lambda df, section, value: df.groupBy("case_id", F.lit(section).alias("section"), value.alias("value")).agg(F.count("*").alias("n"))
    none = F.lit("")
    positions = events.select("case_id", "source_file", "log_position").distinct()
    return count(events, "events", none).unionByName(count(positions, "positions", none)).unionByName(count(markers, "markers", F.col("status"))).unionByName(count(findings, "findings", F.col("severity")))
