"""Which results still describe the evidence: fingerprints of what each stage was made from, kept with its output."""

from __future__ import annotations

from dataclasses import fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from .change_log import Case

#: What each stage reads: inputs of the case and earlier stages.
STAGES = {
    "grouping": ("events", "markers", "log_files"),
    "correlation": ("grouping", "snapshot", "catalog"),
    "reconstruction": ("grouping", "correlation", "catalog"),
    "reconciliation": ("grouping", "correlation", "reconstruction", "snapshot", "catalog", "health", "extractions", "creations"),
}


def inputs_of(stage: str) -> set[str]:
    """The inputs that a stage depends on, through however many earlier ones."""
    return set().union(*[inputs_of(x) if x in STAGES else {x} for x in STAGES[stage]])


def _steady(c: Column, kind: DataType) -> Column:
    """c in a form that hashes alike for equal values: maps as entries in order of their keys."""
    if isinstance(kind, MapType):
        return F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(_steady(e["key"], kind.keyType).alias("k"), _steady(e["value"], kind.valueType).alias("v"))))
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: _steady(x, kind.elementType))
    if isinstance(kind, StructType) and len(kind):
        return F.when(c.isNotNull(), F.struct(*[_steady(c[f.name], f.dataType).alias(f.name) for f in kind]))
    return c


def fingerprint(df: DataFrame, by: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """(by, rows, digest): how many rows and the sums of two hashes of each, whatever their order and partitions.

    Columns enter by name order with a mark for null, so a null and a value that hashes like it differ.
    """
    held = [x for f in sorted(df.schema.fields, key=lambda f: f.name) if f.name not in by for x in (F.col(f"`{f.name}`").isNull(), _steady(F.col(f"`{f.name}`"), f.dataType))]
    total = lambda salt: F.sum(F.xxhash64(F.lit(salt), *held).cast("decimal(38,0)")).cast("string")
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.concat_ws("/", total("a"), total("b")).alias("digest"))


def inputs(case: Case) -> DataFrame:
    """(case_id, input, rows, digest) of every input of every case."""
    held = [f.name for f in fields(case) if f.name in set().union(*map(inputs_of, STAGES))]
    return reduce(DataFrame.unionByName, [fingerprint(getattr(case, n)).select("case_id", F.lit(n).alias("input"), "rows", "digest") for n in held])


def made_from(found: DataFrame) -> DataFrame:
    """(case_id, stage, made_from): one text for everything a stage depends on, from the inputs' fingerprints."""
    needs = [(s, i) for s in STAGES for i in sorted(inputs_of(s))]
    needed = found.sparkSession.createDataFrame(needs, "stage string, input string")
    said = F.concat_ws(":", "input", F.col("rows").cast("string"), "digest")
    return found.join(needed, "input").groupBy("case_id", "stage").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(said)), ";"), 256).alias("made_from"))


def stale(then: DataFrame, now: DataFrame) -> DataFrame:
    """(case_id, stage, changed): stages that must run again, with the inputs that changed, were added or went away.

    then and now: fingerprints of inputs. A stage follows every input that it or a stage before it reads, so a changed
    snapshot leaves transactions as they are and takes all that comes after them. A case that then lacks is stale as a whole.
    """
    old = then.select("case_id", "input", F.col("rows").alias("rows_"), F.col("digest").alias("digest_"))
    both = now.join(old, ["case_id", "input"], "full_outer").filter(~(F.col("rows").eqNullSafe(F.col("rows_")) & F.col("digest").eqNullSafe(F.col("digest_"))))
    needs = now.sparkSession.createDataFrame([(s, i) for s in STAGES for i in inputs_of(s)], "stage string, input string")
    return both.join(needs, "input").groupBy("case_id", "stage").agg(F.array_join(F.array_sort(F.collect_set("input")), ", ").alias("changed"))


def stamped(result: DataFrame, stage: str, prints: DataFrame) -> DataFrame:
    """result with made_from, to be written so."""
    return result.join(prints.filter(F.col("stage") == stage).select("case_id", "made_from"), "case_id")


def fresh(stored: DataFrame, stage: str, prints: DataFrame) -> DataFrame:
    """Rows of a stored result that were made from what the case holds now; others are stale."""
    return stored.join(prints.filter(F.col("stage") == stage).select("case_id", "made_from"), ["case_id", "made_from"], "left_semi").drop("made_from")


def same_results(a: dict[str, DataFrame], b: dict[str, DataFrame]) -> DataFrame:
    """(result, case_id, rows, same): each result of two analyses by its fingerprint; rows are those of the first."""
    part = lambda name: fingerprint(a[name]).join(fingerprint(b[name]).withColumnsRenamed({"rows": "rows_", "digest": "digest_"}), "case_id", "full_outer").select(F.lit(name).alias("result"), "case_id", F.coalesce("rows", F.lit(0)).alias("rows"), (F.col("rows").eqNullSafe(F.col("rows_")) & F.col("digest").eqNullSafe(F.col("digest_"))).alias("same"))
    return reduce(DataFrame.unionByName, [part(n) for n in a])


def stored_counts(case: Case) -> DataFrame:
    """(case_id, kind, n): tables with a schema, each counted once, snapshot rows, events and markers."""
    part = lambda df, kind: df.groupBy("case_id").agg(F.count("*").alias("n")).select("case_id", F.lit(kind).alias("kind"), "n")
    tables = case.catalog.select("case_id", "database", "table").distinct()
    return reduce(DataFrame.unionByName, [part(tables, "schemas"), part(case.snapshot, "physical_records"), part(case.events, "events"), part(case.markers, "markers")])


def scope_counts(selected: Case, stored: Case) -> DataFrame:
    """(case_id, kind, in_scope, stored). More in scope than stored cannot have come from the case and is an error."""
    both = stored_counts(stored).withColumnRenamed("n", "stored").join(stored_counts(selected).withColumnRenamed("n", "in_scope"), ["case_id", "kind"], "full_outer")
    checked = both.select("case_id", "kind", F.coalesce("in_scope", F.lit(0)).alias("in_scope"), F.coalesce("stored", F.lit(0)).alias("stored"))
    over = F.raise_error(F.concat(F.lit("more in scope than stored: "), "kind")).cast("long")
    return checked.withColumn("in_scope", F.when(F.col("in_scope") > F.col("stored"), over).otherwise(F.col("in_scope")))
