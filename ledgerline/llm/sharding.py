"""Sharding by a two-pass external shuffle.

Pass one scatters records over memory-sized buckets by a seeded hash. Pass two takes one bucket at a time and shuffles
it by Fisher-Yates: from the last place down, each place swaps its record with that of a drawn place no further on.
A draw depends on seed, bucket and place alone and a bucket starts in the order of its records' hashes, so neither
partitions nor attempts matter. Buckets laid end to end are one uniform permutation; dealing it out in turn gives
every shard the same number of records, at most one apart.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from .common import cut, shared_dir

#: Size of a bucket: about so many bytes, and so many records (a swap copies the bucket's references).
BUCKET_BYTES, BUCKET_ROWS = 16 << 20, 256
#: Buckets whose offsets are summed together.
SPAN = 4096


def _field(name: str) -> Column:
    return F.col(f"rec.`{name}`")


def _record_bytes(docs: DataFrame) -> Column:
    """About what a record takes: its strings and binaries, and 16 bytes for each other column."""
    sized = [F.coalesce(F.octet_length(_field(c)), F.lit(0)) if t in ("string", "binary") else F.lit(16) for c, t in docs.dtypes]
    return sum(sized, F.lit(48))


def _hashed(field: StructField) -> Column:
    """What is hashed of a column; a map, which has no hash, is hashed as its JSON."""
    return F.to_json(F.struct(_field(field.name))) if "map<" in field.dataType.simpleString() else _field(field.name)


def _packed(docs: DataFrame) -> DataFrame:
    """docs as one column rec, from Parquet files whose names and places stand beside it whatever the files' splits.

    A plain scan of Parquet has them; anything else is written once.
    """
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    nodes = re.findall(r"^[\s:+-]*(\w+)", plan, re.M)
    scan = set(nodes) <= {"Relation", "Project", "Filter"} and plan.rstrip().endswith(" parquet") and "_metadata" not in docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rec"))
    return rows if scan else cut(rows)


def fisher_yates(recs: Column, bucket: Column, seed: int) -> Column:
    """The array recs shuffled: from the last place i down to 1, i swaps with place xxhash64(seed, bucket, i) modulo i + 1."""

    def swap(held: Column, i: Column) -> Column:
        j = F.pmod(F.xxhash64(F.lit(seed), bucket, i), i + 1).cast("int")
        parts = [F.slice(held, F.lit(1), j), F.slice(held, i + 1, F.lit(1)), F.slice(held, j + 2, i - j - 1), F.slice(held, j + 1, F.lit(1)), F.slice(held, i + 2, F.size(held))]
        return F.when(j == i, held).otherwise(F.concat(*parts))

    down = F.when(F.size(recs) > 1, F.sequence(F.size(recs) - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(down, recs, swap)


def shard(docs: DataFrame, n_shards: int = 16, seed: int = 20240, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """All columns of docs, with shard (0 to n_shards - 1) and slot (0, 1, ... within the shard).

    Law `rows`: counts of two shards differ by one at most. An empty table gives an empty result; null ids, null
    texts, very long texts and repeated rows are records like any other. Input columns named shard or slot are
    replaced; columns of any other name stay. The scatter hashes the seed with each record's file name, place in the
    file and contents, so a key that holds a third of all rows spreads like any other. A bucket holds about
    bucket_bytes or bucket_rows, whichever is reached first, whatever the table's size. The same Parquet files give the
    same result whatever their splits, the cores alive and the number of shuffle partitions. What is no plain scan of
    Parquet is written first, to files whose names differ by run, so each call shuffles it differently.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "slot")])
    kept = docs.columns
    packed = _packed(docs)
    size = packed.agg(F.sum(_record_bytes(docs)).alias("bytes"), F.count("*").alias("rows")).first()
    n = max(1, -(-int(size["bytes"] or 0) // bucket_bytes), -(-size["rows"] // bucket_rows))
    content = F.xxhash64(*map(_hashed, docs.schema.fields))
    place = F.xxhash64(F.lit(seed), "_metadata.file_name", "_metadata.row_index", content)
    records = packed.select(F.pmod(F.xxhash64(F.lit(seed), place), F.lit(n)).alias("bucket"), F.struct(place.alias("place"), content.alias("content"), "rec").alias("held"))
    buckets = records.groupBy("bucket").agg(F.collect_list("held").alias("recs"))
    before = lambda a, b, c: F.when(a[c] < b[c], -1).when(a[c] > b[c], 1)
    in_order = F.array_sort("recs", lambda a, b: F.coalesce(before(a, b, "place"), before(a, b, "content"), F.lit(0)))
    mixed = cut(buckets.select("bucket", F.posexplode(fisher_yates(in_order, F.col("bucket"), seed)).alias("at", "held")).select("bucket", "at", "held.rec"))
    sizes = mixed.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("span", F.floor(F.col("bucket") / SPAN))
    within = sizes.withColumn("ahead", F.sum("n").over(Window.partitionBy("span").orderBy("bucket")) - F.col("n"))
    spans = sizes.groupBy("span").agg(F.sum("n").alias("all"))
    earlier = spans.select("span", (F.sum("all").over(Window.orderBy("span")) - F.col("all")).alias("earlier"))
    ahead = within.join(earlier, "span").select("bucket", (F.col("ahead") + F.col("earlier")).alias("ahead"))
    rank = F.col("ahead") + F.col("at")
    return mixed.join(ahead, "bucket").select(
        *[_field(c).alias(c) for c in kept],
        F.pmod(rank, F.lit(n_shards)).cast("int").alias("shard"),
        F.floor(rank / n_shards).cast("long").alias("slot"),
    )


def write_shards(sharded: DataFrame, path: str | None = None) -> str:
    """One folder per shard, in slot order within its files; returns the path."""
    path = path or f"{shared_dir(sharded.sparkSession)}/ledgerline/shards-{uuid.uuid4().hex}"
    sharded.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return path


def digest(sharded: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return sharded.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
