"""Canonical tables in Parquet, one case among many, and frames settled between stages."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where it is unset only a run on one machine has a folder to fall back to."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not (spark.sparkContext.master + "[").startswith("local["):
        raise ValueError("spark.checkpoint.dir is unset: a cluster needs a folder that all executors share")
    return found or "/tmp/ledgerline-checkpoints"


def settle(df: DataFrame) -> DataFrame:
    """Write a frame that feeds several branches to the shared folder and read it back; this also cuts its lineage."""
    path = f"{shared_dir(df.sparkSession)}/ledgerline/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_case(df: DataFrame, path: str, by: tuple[str, ...] = ("case_id",)) -> None:
    """Write rows partitioned by case (and source file for events). Writing a partition again replaces it and no other."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def read_case(spark: SparkSession, path: str, case_id: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if case_id is None else df.filter(F.col("case_id") == case_id)


def repeated_references(events: DataFrame, ref: tuple[str, ...] = ("case_id", "source_file", "log_position", "row_index")) -> DataFrame:
    """References that more than one row carries; a write of events should refuse to go on if there is any."""
    return events.groupBy(*ref).agg(F.count("*").alias("n")).filter("n > 1")


def publish_decode(events: DataFrame, path: str, case_id: str, file: str) -> str:
    """Write one decode of a log under its registered name and publish it; returns the decode's id.

    A decode that holds another case, or more than one source file, was put together wrongly; it is refused, and nothing of
    it can be read. The check reads what was written, so it holds for the very rows that are published; a decode becomes
    readable by one small row in the manifest, written last. A job that dies before that leaves files that no reader takes.
    """
    spark, decode = events.sparkSession, uuid.uuid4().hex
    staged = f"{path}/decodes/decode={decode}"
    events.withColumn("read_as", F.col("source_file")).withColumn("source_file", F.lit(file)).write.parquet(staged)
    found = spark.read.parquet(staged).agg(F.countDistinct("read_as").alias("files"), F.array_sort(F.collect_set(F.when(F.col("case_id") != case_id, F.col("case_id")))).alias("others"), F.min("read_as").alias("a"), F.max("read_as").alias("b")).first()
    if found.files > 1:
        raise ValueError(f"one decode holds events from {found.files} files, {found.a} and {found.b} among them")
    if found.others:
        raise ValueError(f"a decode of case {case_id} holds rows of another")
    known = published(spark, path)
    last = 0 if known is None else known.filter((F.col("case_id") == case_id) & (F.col("file") == file)).agg(F.max("seq")).first()[0] or 0
    spark.createDataFrame([(case_id, file, decode, last + 1)], "case_id string, file string, decode string, seq long").coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return decode


def published(spark: SparkSession, path: str) -> DataFrame | None:
    """(case_id, file, decode, seq): the last published decode of each file, None where nothing was published."""
    try:
        manifest = spark.read.parquet(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    last = F.max_by(F.struct("decode", "seq"), F.struct("seq", "decode"))
    return manifest.groupBy("case_id", "file").agg(last.alias("x")).select("case_id", "file", "x.*")


def read_decodes(spark: SparkSession, path: str) -> DataFrame:
    """Events of the last published decode of each file; Spark reads only the folders that the manifest names."""
    return spark.read.parquet(f"{path}/decodes").join(published(spark, path).select("decode"), "decode", "left_semi").drop("decode", "read_as")
