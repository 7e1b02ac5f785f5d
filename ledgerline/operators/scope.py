"""Scope: which databases and tables an analysis looks at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def within(df: DataFrame, databases: tuple[str, ...] = (), tables: DataFrame | None = None) -> DataFrame:
    """Rows of the databases, or of the (database, table) pairs of tables; everything if neither is given. Case matters."""
    if not databases and tables is None:
        return df
    named = F.col("database").isin(*databases) if databases else F.lit(False)
    if tables is None:
        return df.filter(named)
    listed = tables.select("database", "table").distinct().withColumn("in_", F.lit(True))
    return df.join(listed, ["database", "table"], "left").filter(named | F.col("in_").isNotNull()).drop("in_")


def narrow_markers(markers: DataFrame, events: DataFrame) -> DataFrame:
    """Markers with only the positions at which events are left; a marker that listed some and keeps none goes."""
    held = events.select("case_id", "source_file", "log_position").distinct()
    key = ["case_id", "source_file", "start_position"]
    left = markers.select(*key, F.explode("event_positions").alias("log_position")).join(held, ["case_id", "source_file", "log_position"], "left_semi")
    kept = left.groupBy(*key).agg(F.array_sort(F.collect_list("log_position")).alias("kept_"))
    both = markers.join(kept, key, "left")
    positions = F.coalesce("kept_", F.expr("cast(array() as array<bigint>)"))
    return both.filter((F.size("event_positions") == 0) | F.col("kept_").isNotNull()).withColumn("event_positions", positions).drop("kept_")


def latest_version(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The last version's row of each key; an ordered maximum, which combines before the shuffle."""
    last = F.max_by(F.struct(*df.columns), F.struct(*version))
    return df.groupBy(*keys).agg(last.alias("row_")).select("row_.*")


def latest_runs(runs: DataFrame, by: list[str], n: int = 100) -> DataFrame:
    """The last n rows, shown in ascending order."""
    return runs.orderBy(*[F.desc(c) for c in by]).limit(n).orderBy(*by)
