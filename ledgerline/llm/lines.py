"""Line dedup: repeated runs of lines are found by prefix doubling over line ids, and later copies are deleted.

A line is an id. Rank k of a position stands for the 2^k lines from there; it is the pair of rank k-1 there and 2^(k-1)
lines on. Positions whose rank no other position shares are resolved and leave, so each round works on what is still
repeated. Two overlapping ranks stand for a run of any length, which gives every run of enough words its class, that
is its interval of equal prefixes in suffix order; all but the class's first run are later copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered, small_batches, tidy

#: A run counts if it has so many words.
LEAST_WORDS = 10
POSITIONS = "doc_id long, rid long, line int, rank long, ahead int, back int"


def _positions(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """Every line with its id and the lengths of the shortest run of enough words from it (ahead) and up to it (back); 0: none."""
    for batch in batches:
        out = []
        for doc, rid, text in zip(batch.doc_id, batch.rid, batch.text, strict=True):
            lines = text.split("\n")
            n = len(lines)
            ids = np.fromiter((xxhash.xxh3_64_intdigest(x.encode("utf-8", "replace")) for x in lines), np.uint64, n).view(np.int64)
            upto = np.concatenate([[0], np.cumsum(np.fromiter((len(x.split()) for x in lines), np.int64, n))])
            at = np.arange(n)
            end = np.searchsorted(upto, upto[:-1] + least)
            start = np.searchsorted(upto, upto[1:] - least, side="right") - 1
            out.append(pd.DataFrame({"doc_id": pd.array([doc] * n, "Int64") if pd.isna(doc) else doc, "rid": rid, "line": at.astype("int32"), "rank": ids, "ahead": np.where(end <= n, end - at, 0).astype("int32"), "back": np.where(start >= 0, at - start + 1, 0).astype("int32")}))
            if len(out) == 500:
                yield pd.concat(out)
                out = []
        if out:
            yield pd.concat(out)
    tidy()


def _repeated(ranks: DataFrame) -> DataFrame:
    """Positions whose rank another position shares, written to the shared folder."""
    twice = cut(ranks.groupBy("rank").agg(F.count("*").alias("n")).filter("n > 1").select("rank"))
    return cut(ranks.join(twice, "rank", "left_semi"))


def later_copies(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(rid, start, size): runs of lines whose words are enough and that also start earlier, by doc_id (nulls first), then row, then line.

    docs: doc_id, rid (unique), text. The runs are the shortest ones that begin or end at each line; their union is
    that of all such runs.
    """
    lines = cut(docs.mapInPandas(lambda it: _positions(it, least_words), POSITIONS))
    runs = cut(
        lines.select("doc_id", "rid", F.explode(F.array(F.struct(F.col("line").alias("start"), F.col("ahead").alias("size")), F.struct((F.col("line") - F.col("back") + 1).alias("start"), F.col("back").alias("size")))).alias("r"))
        .select("doc_id", "rid", "r.*").filter("size > 0").distinct()
    )
    top = runs.agg(F.max("size").alias("m")).first()["m"] or 0
    ranks, keyed, k = _repeated(lines.select("rid", "line", "rank")), None, 0
    while top >> k:
        here = runs.filter((F.col("size") >= 1 << k) & (F.col("size") < 2 << k)).join(ranks.withColumnRenamed("line", "start"), ["rid", "start"])
        last = ranks.select("rid", (F.col("line")).alias("tail"), F.col("rank").alias("rank2"))
        both = here.withColumn("tail", F.col("start") + F.col("size") - (1 << k)).join(last, ["rid", "tail"])
        part = both.select("doc_id", "rid", "start", "size", F.xxhash64("size", "rank", "rank2").alias("key"))
        keyed = part if keyed is None else keyed.unionByName(part)
        k += 1
        if not top >> k:
            break
        ahead = ranks.select("rid", (F.col("line") - (1 << (k - 1))).alias("line"), F.col("rank").alias("rank2"))
        ranks = _repeated(ranks.join(ahead, ["rid", "line"]).select("rid", "line", F.xxhash64("rank", "rank2", F.lit(k)).alias("rank")))
        if ranks.isEmpty():
            break
    if keyed is None:
        return docs.sparkSession.createDataFrame([], "rid long, start int, size int")
    keyed = cut(keyed)
    # nulls come first in min as they do in order
    place = F.struct(F.col("doc_id").isNotNull().alias("a"), F.coalesce("doc_id", F.lit(0)).alias("b"), "rid", "start")
    first = cut(keyed.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1"))
    return keyed.join(first, "key").filter(place > F.col("first")).select("rid", "start", "size")


def dedup(docs: DataFrame, least_words: int = LEAST_WORDS, text_col: str = "text") -> DataFrame:
    """docs with text rewritten without later copies, and columns n_lines and n_deleted (replaced if they exist).

    A run of consecutive lines with least_words words or more that also starts earlier, in this document or another,
    is deleted; the first stays. Null text stays null with no lines; an empty text is one empty line and stays. Rows are
    known by an id that is written with them.
    """
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("n_lines", "n_deleted")]
    rows = numbered(docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")))
    plain = rows.select(F.col("row.doc_id").cast("long").alias("doc_id"), "rid", F.col(f"row.`{text_col}`").alias("text")).filter("text is not null")
    gone = later_copies(plain, least_words).groupBy("rid").agg(F.collect_set(F.struct("start", "size")).alias("gone"))

    @F.pandas_udf("struct<text:string,n_lines:int,n_deleted:int>")
    def rebuilt(text: pd.Series, gone: pd.Series) -> pd.DataFrame:
        out = []
        for t, g in zip(text, gone, strict=True):
            if t is None:
                out.append((None, 0, 0))
                continue
            lines = t.split("\n")
            stay = np.ones(len(lines), bool)
            for r in g if g is not None else ():
                stay[r["start"] : r["start"] + r["size"]] = False
            out.append((t if stay.all() else "\n".join([x for x, s in zip(lines, stay, strict=True) if s]), len(lines), int((~stay).sum())))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_deleted"])

    joined = rows.join(gone, "rid", "left").withColumn("new", rebuilt(F.col(f"row.`{text_col}`"), F.col("gone")))
    return joined.select(*[F.col("new.text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in kept], "new.n_lines", "new.n_deleted")


def digest(deduped: DataFrame) -> DataFrame:
    return deduped.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_lines").cast("long").alias("n_lines"), F.col("n_deleted").cast("long").alias("n_deleted"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))

