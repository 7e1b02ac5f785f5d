"""One query per operator over its whole table; SQL where SQL can state the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, chat, decontaminate, fingerprints, hard_negatives, jaccard, lines, neighbours, oracle, secrets, sharding, suffixes, toxicity
from .common import cut, table


def op1_balanced_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.search(vectors, vectors.filter("vec_id % 50 = 0"))


def op2_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs: what the first has seen of the versions, the ledger spares the second, which covers all of them."""
    versions = table(spark, sf_dir, "documents")
    _, ledger = secrets.ledger_scan(versions.filter(F.xxhash64("doc_id") < 0))
    findings, _ = secrets.ledger_scan(versions, cut(ledger))
    return secrets.digest(findings)


def op3_chat_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digest(chat.format_conversations(rows))


def op4_token_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, _ = jaccard.link(table(spark, sf_dir, "documents"), width=4, percent=85)
    return jaccard.digest(members)


def op5_suffix_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(suffixes.dedup(table(spark, sf_dir, "documents")))


def op6_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(lines.dedup(table(spark, sf_dir, "documents")))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(sharding.shard(table(spark, sf_dir, "documents")))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digest(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.digest(fingerprints.changed(table(spark, sf_dir, "documents")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = hard_negatives.prepare(table(spark, sf_dir, "embeddings"))
    return hard_negatives.mine(coded, coded.rows.filter("vec_id % 50 = 0"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.digest(*centroids.cluster(table(spark, sf_dir, "embeddings")))


QUERIES = {
    "op1_balanced_lists": op1_balanced_lists,
    "op2_secret_ledger": op2_secret_ledger,
    "op3_chat_render": op3_chat_render,
    "op4_token_groups": op4_token_groups,
    "op5_suffix_blocks": op5_suffix_blocks,
    "op6_line_runs": op6_line_runs,
    "op7_shards": op7_shards,
    "op8_toxicity": op8_toxicity,
    "op9_bpe": op9_bpe,
    "op10_decontaminate": op10_decontaminate,
    "op11_merkle": op11_merkle,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_centroids": op13_centroids,
}

ORACLE_SQL: dict[str, str] = {"op11_merkle": oracle.OP11, "op12_hard_negatives": oracle.OP12, "op13_centroids": oracle.OP13}
