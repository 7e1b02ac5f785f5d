"""From raw documents to token ids in five stages, each written as Parquet and read again by the next.

A stage is (name, function of (spark, docs, sf_dir)). It works on all rows the one before it kept; all but the last
return the columns of documents, whatever these are beside doc_id, text and n_chars. Every stage takes an empty table
(and returns one), null ids, repeated ids and rows, and texts of any length; what it does with them is said below.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import bpe, decontaminate, jaccard, lines, toxicity
from ledgerline.llm.common import cut, table
from ledgerline.llm.queries import tokenizer_path


def _beside(docs: DataFrame, names: tuple[str, ...], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work(docs) with the columns of docs as they were, also those whose names an operator gives to columns of its own."""
    aside = {c: f"{c}-{uuid.uuid4().hex}" for c in docs.columns if c.lower() in names}
    return work(docs.withColumnsRenamed(aside)).select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold by a classifier fitted on the labelled rows among them that may be learned from.

    A null text scores as the empty one, equal texts alike, so copies stay or go together; the threshold itself is
    toxic. Without labels of both classes every document stays.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(~toxicity.held_out()))
    return _beside(docs, ("score",), lambda rows: toxicity.score(rows, model).filter(F.col("score") < toxicity.THRESHOLD))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of line runs; a document of which no line is left goes. n_chars follows the text.

    First is the least doc_id (null before all), then the row, then the line. Null and empty texts have nothing to
    delete and stay.
    """

    def work(rows: DataFrame) -> DataFrame:
        out = lines.dedup(rows).filter((F.col("n_deleted") < F.col("n_lines")) | (F.col("n_lines") == 0))
        size = F.when(F.col("n_deleted") > 0, F.length("text")).otherwise(F.col("n_chars"))
        return out.withColumn("n_chars", size.cast(docs.schema["n_chars"].dataType))

    return _beside(docs, ("n_lines", "n_deleted"), work)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of least doc_id: five-word shingles, similarity 0.8 or more.

    Rows are told apart by doc_id and text, so of equal rows one stays; null and blank texts are like no other and all
    stay, as do rows without doc_id.
    """
    return jaccard.representatives(docs, width=5, percent=80).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; an empty benchmark keeps all."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row; null and empty texts have no ids.

    Each row's ids are decoded and compared with its text; ids that give another one stop the stage.
    """
    encoded = bpe.encode_checked(docs, tokenizer_path())
    refuse = F.raise_error(F.concat(F.lit("ids do not decode to the text of doc_id "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).cast("long")
    n_tokens = F.when(F.col("intact"), F.size("ids").cast("long")).otherwise(refuse)
    return encoded.select("doc_id", n_tokens.alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("tokens", to_tokens),
]

#: The stages learn, follow chains of links and count subwords; SQL states none of that.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
