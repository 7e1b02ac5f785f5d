"""Order: log files by the server's list, events by place and never by time, records by their keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import settle
from .values import basename

KEY_WIDTH = 65


def file_sequence(log_files: DataFrame) -> DataFrame:
    """(case_id, file, file_seq): place of each listed file by base name, the first if it is listed twice."""
    return log_files.groupBy("case_id", basename(F.col("file")).alias("file")).agg(F.min("seq").cast("int").alias("file_seq"))


def with_order(events: DataFrame, log_files: DataFrame) -> DataFrame:
    """events with ord, a struct that orders them: listed files in sequence, then others by name, then position and row.

    The list of files is small and bounded by what a server keeps, and joins on case and file.
    """
    listed = log_files.groupBy("case_id").agg(F.max("seq").cast("int").alias("last_seq"))
    placed = events.withColumn("base_", basename(F.col("source_file"))).join(file_sequence(log_files).withColumnsRenamed({"file": "base_"}), ["case_id", "base_"], "left").join(listed, "case_id", "left")
    seq = F.coalesce("file_seq", F.col("last_seq") + 1, F.lit(0))
    ord_ = F.struct(seq.alias("seq"), F.col("base_").alias("name"), F.col("log_position").alias("position"), F.col("row_index").alias("row"))
    return placed.withColumn("ord", ord_).drop("base_", "file_seq", "last_seq")


def key_order(pk: Column) -> Column:
    """Sortable form of a key: component by component, numbers before text and by size, whatever their length."""

    def part(c: Column) -> Column:
        digits = F.regexp_replace(F.regexp_replace(c, "^-", ""), "^0+(?=.)", "")
        padded = F.lpad(digits, KEY_WIDTH, "0")
        least = F.translate(padded, "0123456789", "9876543210")
        return F.when(c.rlike("^-[0-9]+$"), F.struct(F.lit(0).alias("kind"), least.alias("text"))).when(c.rlike("^[0-9]+$"), F.struct(F.lit(1).alias("kind"), padded.alias("text"))).otherwise(F.struct(F.lit(2).alias("kind"), c.alias("text")))

    return F.transform(F.split(pk, r"\|"), part)


def ranked(df: DataFrame, by: list[Column], into: str = "ordinal", within: str = "case_id") -> DataFrame:
    """df with a gapless ordinal from 0 per case.

    Rows are dealt to ranges of (case, order) and sorted there; an ordinal is the place within the range plus the sizes of
    the ranges before it, so a case is never one task. The sorted rows are written once: a range's bounds are drawn from a
    sample and would not be the same the second time.
    """
    names = [f"by{n}_" for n in range(len(by))]
    spread = df.select("*", *[c.alias(n) for c, n in zip(by, names, strict=True)]).repartitionByRange(within, *names).sortWithinPartitions(within, *names)
    placed = settle(spread.drop(*names).withColumn("at_", F.monotonically_increasing_id()))
    part = F.shiftright("at_", 33).alias("part_")
    sizes = placed.groupBy(within, part).agg(F.min("at_").alias("first_"), F.count("*").alias("size_"))
    earlier = Window.partitionBy(within).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(within, "part_", (F.coalesce(F.sum("size_").over(earlier), F.lit(0)) - F.col("first_")).alias("offset_"))
    return placed.select("*", part).join(offsets, [within, "part_"]).withColumn(into, (F.col("at_") + F.col("offset_")).cast("long")).drop("at_", "part_", "offset_")
