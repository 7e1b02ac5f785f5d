"""Benchmark decontamination: a BM25 inverted index of test items, queried by every training passage.

A passage is the query, an item the document searched for. Impacts are divided by the score an item must reach, so
one threshold, 1, serves all items, and block-max WAND applies as it stands: items lie in blocks, every term has its
largest impact in each block, blocks whose bounds cannot sum to 1 are skipped, and within a block cursors move to the
pivot. What is retrieved is verified: enough of the question's and of the answer's word runs must stand in the passage.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered, small_batches, tidy

K1, B = 1.2, 0.75
#: Share of its score against itself that an item must get from a passage.
SHARE = 0.6
#: Word runs of so many words, and the share of them that must be found.
RUN, OVERLAP = 5, 0.8
#: Items held by one index, and indexes searched by one function: storage alone, scores do not depend on them.
ITEMS_AT_ONCE, INDEXES_AT_ONCE = 1024, 16
BLOCK_ITEMS = 4
LEAST_PASSAGE = 64
WORD = re.compile(r"[^\W_]+")
HITS = "array<struct<item_id:long,score:double,question:double,answer:double>>"


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def runs(w: list[str]) -> set[tuple[str, ...]]:
    """Runs of RUN words; the whole text where it has fewer."""
    return {tuple(w[i : i + RUN]) for i in range(max(1, len(w) - RUN + 1))} if w else set()


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The last sentence is the answer; an item of one sentence is halved."""
    parts = [w for w in (words(p) for p in re.split(r"(?<=[.!?])\s+|\n", text)) if w]
    if len(parts) > 1:
        return [x for p in parts[:-1] for x in p], parts[-1]
    own = parts[0] if parts else []
    return own[: (len(own) + 1) // 2], own[(len(own) + 1) // 2 :]


@dataclass
class Index:
    ids: np.ndarray
    vocab: dict[str, int]
    #: Largest impact of a term in a block; the last row is for words that no item has.
    bounds: np.ndarray
    #: For each term its postings (item, impact) by block, in order of item.
    postings: list[dict[int, list[tuple[int, float]]]]
    question: list[set]
    answer: list[set]
    longest: int

    @classmethod
    def build(cls, items: list[tuple[int, str]], df: dict[str, int], n: int, average: float, longest: int) -> Index:
        """An index of some items; df, n, average and longest are those of all items of the benchmark."""
        items = [(i, t, w) for i, t, w in ((i, t, words(t or "")) for i, t in items) if w]
        counts = [Counter(w) for *_, w in items]
        vocab = {t: k for k, t in enumerate(sorted({t for c in counts for t in c}))}
        postings: list[dict[int, list[tuple[int, float]]]] = [{} for _ in vocab]
        bounds = np.zeros((len(vocab) + 1, max(1, -(-len(items) // BLOCK_ITEMS))), np.float32)
        for j, (c, (*_, w)) in enumerate(zip(counts, items, strict=True)):
            impact = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(w) / average)) for t, f in sorted(c.items())}
            need = SHARE * sum(impact.values())
            for t, x in impact.items():
                postings[vocab[t]].setdefault(j // BLOCK_ITEMS, []).append((j, x / need))
                bounds[vocab[t], j // BLOCK_ITEMS] = max(bounds[vocab[t], j // BLOCK_ITEMS], x / need)
        parts = [question_and_answer(t) for _, t, _ in items]
        return cls(np.array([i for i, *_ in items], np.int64), vocab, bounds, postings, [runs(q) for q, _ in parts], [runs(a) if a else set() for _, a in parts], longest)

    def wand(self, terms: list[int], block: int) -> list[tuple[int, float]]:
        """Items of one block that the terms score 1 or more, by moving cursors to the pivot."""
        lists = ((self.postings[t].get(block), t) for t in terms)
        cursors = [[own[0][0], 0, own, float(self.bounds[t, block])] for own, t in lists if own]
        found = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            total, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                total += c[3]
                if total >= 1 - 1e-6:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            if cursors[0][0] == item:
                score = sum(c[2][c[1]][1] for c in cursors if c[0] == item)
                if score >= 1:
                    found.append((item, score))
                target = item + 1
            else:
                target = item
            moved = []
            for c in cursors:
                if c[0] < target:
                    while c[1] < len(c[2]) and c[2][c[1]][0] < target:
                        c[1] += 1
                    if c[1] == len(c[2]):
                        continue
                    c[0] = c[2][c[1]][0]
                moved.append(c)
            cursors = moved
        return found

    def search(self, w: list[str]) -> list[tuple[int, float, float, float]]:
        """(item_id, best score, question overlap, answer overlap) of items that a text of these words holds, by item_id."""
        none = len(self.vocab)
        get = self.vocab.get
        own = np.array([get(x, none) for x in w], np.int32)
        step = max(LEAST_PASSAGE, self.longest)
        starts = np.arange(0, max(1, len(w) - step), step)
        best: dict[int, tuple[float, float, float]] = {}
        for at in range(0, len(starts), 512):
            some = starts[at : at + 512]
            end = int(some[-1]) + 2 * step
            piece = own[some[0] : end]
            padded = np.full(end - int(some[0]), none, np.int32)
            padded[: len(piece)] = piece
            held = np.sort(np.lib.stride_tricks.sliding_window_view(padded, 2 * step)[::step][: len(some)], axis=1)
            held[:, 1:][held[:, 1:] == held[:, :-1]] = none
            full = np.flatnonzero((held < none).sum(axis=1))
            reach = np.zeros((len(some), self.bounds.shape[1]), np.float32)
            for k in range(0, len(full), 64):
                reach[full[k : k + 64]] = self.bounds[held[full[k : k + 64]]].sum(axis=1)
            for p in np.flatnonzero((reach >= 1 - 1e-4).any(axis=1)).tolist():
                terms = [t for t in held[p].tolist() if t < none]
                near = None
                for block in np.flatnonzero(reach[p] >= 1 - 1e-4).tolist():
                    for item, score in self.wand(terms, block):
                        near = near if near is not None else self._runs(w[some[p] : some[p] + 2 * step])
                        q, a = (len(part & near) / len(part) if part else 1.0 for part in (self.question[item], self.answer[item]))
                        if q >= OVERLAP and a >= OVERLAP and score > best.get(item, (0.0,))[0]:
                            best[item] = score, q, a
        return sorted((int(self.ids[j]), s * SHARE, q, a) for j, (s, q, a) in best.items())

    def _runs(self, w: list[str]) -> set:
        near = runs(w)
        short = {len(r) for part in (*self.question, *self.answer) for r in part if len(r) < RUN}
        return near | {tuple(w[i : i + n]) for n in short for i in range(len(w) - n + 1)}


@lru_cache(maxsize=1)
def _indexes(packed: tuple[bytes, ...]) -> list[Index]:
    return [pickle.loads(p) for p in packed]


def _built(items: DataFrame) -> DataFrame:
    """(packed): the indexes of ITEMS_AT_ONCE items or so each, built by tasks from the statistics of all items."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [words(t) for t in batch["text"]]
            yield batch.assign(size=[len(w) for w in own], terms=[sorted(set(w)) for w in own])

    rows = numbered(items.mapInPandas(counted, "id long, text string, size long, terms array<string>").filter("size > 0"))
    n, total, longest = rows.agg(F.count("*"), F.sum("size"), F.max("size")).first()
    if not n:
        return items.sparkSession.createDataFrame([], "packed binary")
    df = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    known = rows.select("rid", F.explode("terms").alias("term")).join(df, "term").groupBy("rid").agg(F.collect_list(F.struct("term", "df")).alias("known"))
    blocks = -(-n // ITEMS_AT_ONCE)

    def build(some: pd.DataFrame) -> pd.DataFrame:
        some = some.sort_values(["id", "text"])
        held = {x["term"]: x["df"] for own in some["known"] for x in own}
        return pd.DataFrame({"packed": [pickle.dumps(Index.build(list(zip(some["id"], some["text"], strict=True)), held, n, total / n, longest))]})

    placed = rows.select("rid", "id", "text").join(known, "rid").withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(blocks)))
    return cut(placed.groupBy("block").applyInPandas(build, "packed binary"))


def hits(items: DataFrame, text: Column, id_col: str = "item_id", text_col: str = "text") -> Column:
    """Array of the benchmark items that a text holds: (item_id, score as a share of the item's own, question and answer overlap), by item_id.

    Null or empty texts and items match nothing; equal items are each reported, items without an id are not used.
    Every passage of the whole text is a query. Indexes are built by tasks and broadcast; INDEXES_AT_ONCE of them, some
    ten MB, are what one function holds, and a larger benchmark has more functions.
    """
    spark = items.sparkSession
    small_batches(spark)
    rows = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    found = []

    def searched(some: list[bytes]) -> Column:
        held = spark.sparkContext.broadcast(tuple(some))

        @F.pandas_udf(HITS)
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            indexes = _indexes(held.value)
            for batch in batches:
                out = []
                for t in batch:
                    w = words(t)
                    out.append([dict(zip(("item_id", "score", "question", "answer"), h, strict=True)) for index in indexes for h in index.search(w)])
                yield pd.Series(out)
            # workers live on: the indexes are not kept for other stages
            del indexes
            _indexes.cache_clear()
            tidy()

        return run(F.coalesce(text, F.lit("")))

    some: list[bytes] = []
    for r in _built(rows).toLocalIterator():
        some.append(bytes(r.packed))
        if len(some) == INDEXES_AT_ONCE:
            found, some = [*found, searched(some)], []
    if some:
        found.append(searched(some))
    return F.array_sort(F.concat(F.expr(f"cast(array() as {HITS})"), *found))


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each pair of document and item found in it: doc_id, item_id, score, question_overlap, answer_overlap.

    Rows that repeat a doc_id, and rows without one, are documents of their own; null and empty texts hold nothing, very
    long ones are searched whole; other columns are not read. Empty tables give an empty result.
    """
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), hits(items, F.col("text")).alias("found"))
    return found.select("doc_id", F.explode("found").alias("x")).select("doc_id", "x.item_id", F.round("x.score", 9).alias("score"), F.col("x.question").alias("question_overlap"), F.col("x.answer").alias("answer_overlap"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that hold no item, with their own columns, whatever their names; null and empty texts stay."""
    return docs.filter(F.size(hits(items, F.col("text"))) == 0)
