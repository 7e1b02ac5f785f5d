"""N-gram Jaccard join by a token-group matrix.

Documents with the same set of word shingles are one set. Sets that could be linked share some of their rarest
shingles. A set is grouped with the set it shares most of those with, and first compared with that one alone, which
joins most of a group. What is left is the matrix of groups and tokens: a set asks every part of a group with which it
shares enough rare tokens and whose members are not all joined with it already. In a part, the union of its members'
tokens bounds the overlap that a query can have with any of them; only parts that could reach the threshold are opened,
member by member, by exact overlap. A task joins what it links as it goes, so it lists links that join something new and
never the pairs of a group. No candidate is dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, small_batches, tidy

#: A token in more than one of so many documents counts as frequent and is tried last. This is an order, not a filter.
FREQUENT_ONE_IN = 1000
#: Frequent tokens kept, most frequent first: bounds what is broadcast to 8 MB.
FREQUENT_MOST = 1_000_000
#: Tokens of the members in one part of a group, and of the queries that one task compares with it.
PART_TOKENS, ASK_TOKENS = 400_000, 800_000
#: Classes of set size: so many for each factor of e, so that a part's members are of like size.
SIZE_CLASSES = 8
#: Ids that are broadcast at most when texts are fetched; beyond it the join is shuffled.
BROADCAST_IDS = 500_000
PIECE_BYTES = 1 << 20
#: Tokens that a task counts at a time.
COUNTED_TOKENS = 4_000_000
#: Words kept with their hashes in one worker; past it the words start anew.
CACHE_WORDS = 200_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class _Hashes(dict):
    """64 bits of each word asked for (XXH3, and BLAKE2b of long words): no words of any form collide but by chance."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word) if len(word) <= 64 else int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = h
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def token_sets(texts: list[str], width: int, known: _Hashes | None = None) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles of so many words (all its words, if fewer)."""
    data = [t.encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts]
    known, out, at = _Hashes() if known is None else known, [], 0
    while at < len(data):
        end, size = at, 0
        while end < len(data) and (end == at or size + len(data[end]) < PIECE_BYTES):
            size += len(data[end]) + 1
            end += 1
        out += _piece(data[at:end], width, known)
        at = end
    return out


def _piece(data: list[bytes], width: int, known: _Hashes) -> list[np.ndarray]:
    # bytes.split() divides at exactly the six bytes that divide words
    words = [d.split() for d in data]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    word = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.uint64, int(counts.sum()))
    shingle = np.zeros(max(0, len(word) - width + 1), np.uint64)
    for k in range(width):
        shingle = _mixed(shingle * _ODD + word[k : len(word) - width + 1 + k])
    out, low = [], 0
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(shingle[low : low + n - width + 1]))
        elif n:
            h = np.zeros(1, np.uint64)
            for k in range(low, low + n):
                h = _mixed(h * _ODD + word[k])
            out.append(h + np.uint64(n))
        else:
            out.append(np.zeros(0, np.uint64))
        low += n
    return out


def least_overlap(n: np.ndarray | int, percent: int):
    """Tokens that a set of n shares with any set it is linked to."""
    return -(-percent * n // 100)


def least_shared(n):
    """Linked sets share so many of the tokens that each keeps, the smaller of the two numbers: keeping one token more
    than the threshold demands makes one more shared token certain."""
    return 1 + n // 40


def reaches(overlap: int, n: int, m: int, percent: int) -> bool:
    """Whether sets of n and m with this overlap have a Jaccard index of percent or more."""
    return overlap * (100 + percent) >= percent * (n + m)


def _frequent(texts: DataFrame, width: int, documents: int) -> np.ndarray:
    """Tokens that stand in many documents: those often seen among COUNTED_TOKENS of a task, by their summed counts."""

    def often(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, sets, size = _Hashes(), [], 0

        def counted() -> pd.DataFrame:
            tokens, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, int))
            keep = n >= max(4, len(sets) // (2 * FREQUENT_ONE_IN))
            sets.clear()
            return pd.DataFrame({"token": tokens[keep].view(np.int64), "n": n[keep]})

        for batch in batches:
            new = token_sets(batch["text"].tolist(), width, known)
            sets += new
            size += sum(map(len, new))
            if size >= COUNTED_TOKENS:
                yield counted()
                size = 0
        yield counted()
        tidy()

    counted = texts.select("text").mapInPandas(often, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") * FREQUENT_ONE_IN >= documents)
    rows = counted.orderBy(F.desc("n"), "token").limit(FREQUENT_MOST).select("token").toPandas()
    return np.sort(rows.token.to_numpy(np.int64).view(np.uint64))


def _sets(docs: DataFrame, width: int, percent: int, frequent) -> DataFrame:
    """(doc_id, text_hash, n, sig, prefix) of each document; prefix: its rarest tokens, of which it shares least_shared with any set it
    is linked to."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, known = frequent.value, _Hashes()
        for batch in batches:
            out = []
            for s in token_sets(batch["text"].tolist(), width, known):
                if not len(s):
                    out.append((0, b"", []))
                    continue
                late = np.isin(s, last, assume_unique=True)
                order = np.concatenate([s[~late], s[late]])[: len(s) - int(least_overlap(len(s), percent)) + least_shared(len(s))]
                out.append((len(s), _sig(s), order.view(np.int64)))
            yield pd.concat([batch[["doc_id", "text_hash"]].reset_index(drop=True), pd.DataFrame(out, columns=["n", "sig", "prefix"])], axis=1)
        tidy()

    return docs.withColumn("text_hash", F.xxhash64("text")).mapInPandas(run, "doc_id long, text_hash long, n long, sig binary, prefix array<long>")


def _sig(s: np.ndarray) -> bytes:
    """160 bits that stand for a set of tokens."""
    one, two = _mixed(s), _mixed(s + _ODD)
    return np.array([one.sum(), two.sum() ^ np.bitwise_xor.reduce(one), len(s)], np.uint64).tobytes()[:20]


def _tokens(sets: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(sid, tokens) of the sets (sid, rep, sig), each from one document that has it; written."""
    wanted = sets.select("sid", "rep", "sig")
    reps = wanted.select(F.col("rep").alias("doc_id")).distinct()
    reps = F.broadcast(reps) if wanted.count() <= BROADCAST_IDS else reps

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = token_sets(batch["text"].tolist(), width)
            yield pd.DataFrame({"rep": batch["doc_id"], "sig": [_sig(s) if len(s) else b"" for s in found], "tokens": [s.view(np.int64) for s in found]})

    held = docs.join(reps, "doc_id", "left_semi").mapInPandas(run, "rep long, sig binary, tokens array<long>")
    # several rows may carry one id: the set's own signature tells which is meant, and equal rows are one
    return cut(held.join(wanted, ["rep", "sig"]).dropDuplicates(["sid"]).select("sid", "tokens"))


def _opened(asks: dict[str, np.ndarray], members: dict[str, np.ndarray], percent: int, every: bool) -> Iterator[tuple[int, int, int, int]]:
    """Links of queries and members of one part: (a, b, a_root, b_root).

    Without every, only links that join roots which nothing before them in this part has joined; a pair within one
    group is looked at once.
    """
    size, sid, grp, core = members["n"], members["sid"], members["grp"], members["core"]
    flat = np.concatenate(members["tokens"])
    order = np.argsort(flat, kind="stable")
    owner = np.repeat(np.arange(len(size)), size)[order]
    union, first = np.unique(flat[order], return_index=True)
    stop = np.append(first[1:], len(flat))
    own, label = np.unique(np.concatenate([members["root"], asks["root"]]), return_inverse=True)
    of_member, of_ask = label[: len(size)], label[len(size) :]
    least = int(size.min())
    for i, (q, n, home, mine, tokens) in enumerate(zip(asks["sid"], asks["n"], asks["home"], asks["core"], asks["tokens"], strict=True)):
        near = (np.minimum(n, size) * 100 >= percent * np.maximum(n, size)) & ((grp != home) | (core != mine) | (sid < q))
        if not every:
            near &= of_member != of_ask[i]
        if not near.any():
            continue
        at = np.searchsorted(union, tokens)
        at[at == len(union)] = 0
        at = at[union[at] == tokens]
        # the union's overlap bounds that of every member
        if not reaches(len(at), n, max(least, int(least_overlap(n, percent))), percent):
            continue
        many = stop[at] - first[at]
        places = np.arange(int(many.sum())) + np.repeat(first[at] - (np.cumsum(many) - many), many)
        shared = np.bincount(owner[places], minlength=len(size))
        for m in np.flatnonzero(near & (shared * (100 + percent) >= percent * (n + size))).tolist():
            if every:
                yield q, sid[m], 0, 0
            elif of_member[m] != of_ask[i]:
                one, two = of_ask[i], of_member[m]
                yield q, sid[m], own[one], own[two]
                of_member[of_member == two] = one
                of_ask[of_ask == two] = one


def _by_name(rows: pd.DataFrame) -> dict[str, dict[str, np.ndarray]]:
    """Columns of the rows of each name."""
    rows = rows.sort_values("name", kind="stable")
    columns = {c: rows[c].to_numpy() for c in rows.columns}
    names, first = np.unique(columns["name"].astype(str), return_index=True)
    ends = [*first[1:].tolist(), len(rows)][: len(names)]
    return {k: {c: v[low:high] for c, v in columns.items()} for k, low, high in zip(names.tolist(), first.tolist(), ends, strict=True)}


def _open(asks: DataFrame, members: DataFrame, percent: int, every: bool) -> DataFrame:
    """_opened over all parts (name). A part's queries are dealt to shares of ASK_TOKENS, each with the part's members; small parts share a task."""
    salts = asks.groupBy("name").agg(F.sum("n").alias("asked"), F.ceil(F.sum("n") / ASK_TOKENS).cast("int").alias("salts"))
    salts = cut(salts.join(members.groupBy("name").agg(F.sum("n").alias("held")), "name"))
    total = salts.agg(F.sum(F.col("asked") + F.col("held") * F.col("salts")).alias("t")).first()["t"] or 0
    tasks = max(1, -(-int(total) // (PART_TOKENS + ASK_TOKENS)))
    spread = asks.join(salts.select("name", "salts"), "name").withColumn("salt", F.pmod(F.xxhash64("sid"), F.col("salts")).cast("int"))
    copies = members.join(salts.select("name", "salts"), "name").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    share = F.concat_ws("/", "name", F.col("salt").cast("string")).alias("name")
    task = F.pmod(F.xxhash64("name", "salt"), F.lit(tasks)).cast("int").alias("task")
    left = spread.select(task, share, "sid", "n", "root", "home", "core", "tokens")
    right = copies.select(task, share, "sid", "n", "root", "grp", "core", "tokens").select(*[F.col(c).alias(f"m_{c}") for c in ("task", "name", "sid", "n", "root", "grp", "core", "tokens")])

    def run(asks: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        held = _by_name(members.rename(columns=lambda c: c.removeprefix("m_")))
        found = [link for name, own in _by_name(asks).items() if name in held for link in _opened(own, held[name], percent, every)]
        return pd.DataFrame(found, columns=["a", "b", "a_root", "b_root"]).astype("int64")

    return cut(left.groupBy("task").cogroup(right.groupBy("m_task")).applyInPandas(run, "a long, b long, a_root long, b_root long"))


def _posted(sets: DataFrame) -> DataFrame:
    """(token, sid, center) of every rare token that several sets have, center being the least of them; written."""
    postings = sets.select("sid", F.explode("prefix").alias("token"))
    shared = postings.groupBy("token").agg(F.count("*").alias("df"), F.min("sid").alias("center")).filter("df > 1").select("token", "center")
    return cut(postings.join(shared, "token"))


def link(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", every: bool = False) -> tuple[DataFrame, DataFrame]:
    """(members, links).

    members: one row per row of docs: doc_id, text_hash, n_shingles, component_id (least doc_id reachable by links,
    itself included), sid. links: pairs of different sets (a, b) that span the components, or with every all pairs of different
    sets that are linked, each once, which may be many more. Two documents are linked when the
    Jaccard index of their shingle sets is percent or more. Null, empty and blank texts have no shingles and no links;
    rows without doc_id have no links either and a null component_id; rows that repeat an id are rows of their own, and
    ties are linked like any other pair. Texts are taken whole, however long; other columns are not read. An empty
    table gives empty results.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    frequent = spark.sparkContext.broadcast(_frequent(texts, width, max(1, texts.count())))
    rows = cut(_sets(texts, width, percent, frequent))
    distinct = rows.filter("n > 0 and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    sets = cut(distinct.withColumn("sid", F.monotonically_increasing_id()))
    posted = _posted(sets)

    # groups: each set is with the first set it shares most of its tokens with
    most = posted.groupBy("sid", "center").agg(F.count("*").alias("shared")).groupBy("sid").agg(F.max(F.struct("shared", (-F.col("center")).alias("less"))).alias("top"))
    groups = cut(most.select("sid", (-F.col("top.less")).alias("grp"), F.col("top.shared").alias("shared")).join(sets.select("sid", "n", "rep", "sig"), "sid"))
    sizes = groups.select(F.col("sid").alias("grp"), F.col("n").alias("center_n"))
    near = groups.filter("sid <> grp").join(sizes, "grp").filter((F.least("n", "center_n") * 100 >= percent * F.greatest("n", "center_n")) & (F.col("shared") > F.floor(F.least("n", "center_n") / 40)))
    near = cut(near.select("sid", "grp", "n"))
    first = cut(near.select("sid").union(near.select(F.col("grp").alias("sid"))).distinct())
    held = _tokens(groups.join(first, "sid", "left_semi"), texts, width)
    none = F.lit(False).alias("core")
    own = F.col("sid").alias("root")
    asks = near.select(F.col("grp").alias("name"), "sid", "n", own, F.col("sid").alias("home"), none).join(held, "sid")
    centers = groups.join(near.select(F.col("grp").alias("sid")).distinct(), "sid", "left_semi").select(F.col("sid").alias("name"), "sid", "n", own, F.lit(-1).cast("long").alias("grp"), none).join(held, "sid")
    stars = _open(asks, centers, percent, False).select("a", "b")
    linked = cut(components(stars))

    # members that are joined with their group's center make up parts of their own
    of_center = linked.select(F.col("node").alias("grp"), F.col("root").alias("center_root"))
    placed = groups.join(linked.select(F.col("node").alias("sid"), "root"), "sid", "left").join(of_center, "grp", "left")
    joined = F.coalesce("root", "sid") == F.coalesce("center_root", "grp")
    placed = placed.select("sid", "grp", "n", "rep", "sig", (F.col("sid") if every else F.coalesce("root", "sid")).alias("root"), (F.lit(False) if every else joined).alias("core"), F.floor(F.log("n") * SIZE_CLASSES).cast("int").alias("class"))
    chunks = placed.groupBy("grp", "core", "class").agg(F.ceil(F.sum("n") / PART_TOKENS).cast("int").alias("chunks"))
    parts = cut(placed.join(chunks, ["grp", "core", "class"]).withColumn("part", F.pmod(F.xxhash64("sid"), F.col("chunks")).cast("int")).drop("chunks"))

    # the token-group matrix: which parts hold a token, and which sets ask for them
    key = ["grp", "core", "class", "part"]
    held_by = posted.select("token", "sid").join(parts, "sid")
    matrix = held_by.groupBy("token", *key).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("root").alias("low"), F.max("root").alias("high"))
    asked = held_by.select("token", "sid", F.col("n").alias("qn"), F.col("grp").alias("home"), F.col("core").alias("q_core"), F.col("root").alias("q_root"))
    fits = (F.col("home") >= F.col("grp")) & (F.col("qn") * 100 >= percent * F.col("least")) & (F.col("most") * 100 >= percent * F.col("qn"))
    # of a joined and an unjoined member of one group, the unjoined one asks
    fits &= ~((F.col("home") == F.col("grp")) & F.col("q_core") & ~F.col("core"))
    fits &= ~((F.col("low") == F.col("q_root")) & (F.col("high") == F.col("q_root")))
    met = asked.join(matrix, "token").filter(fits).groupBy("sid", *key).agg(F.count("*").alias("shared"), F.first("qn").alias("qn"), F.min("least").alias("least"))
    enough = F.least(F.floor(F.col("qn") / 40), F.floor(F.greatest("least", F.ceil(F.col("qn") * percent / 100)) / 40)) + 1
    pairs = cut(met.filter(F.col("shared") >= enough).select("sid", *key))
    open_parts = cut(pairs.select(*key).distinct())
    inside = cut(parts.join(open_parts, key, "left_semi"))
    more = pairs.select("sid").union(inside.select("sid")).distinct().join(first, "sid", "left_anti")
    held = held.unionByName(_tokens(groups.join(more, "sid", "left_semi"), texts, width))
    name = F.concat_ws("/", *[F.col(c).cast("string") for c in key]).alias("name")
    asks = pairs.select("sid", name).join(parts.select("sid", "n", "root", F.col("grp").alias("home"), "core"), "sid").join(held, "sid")
    members = inside.select(name, "sid", "n", "root", "grp", "core").join(held, "sid")
    found = _open(asks, members, percent, every)
    links = found.select("a", "b").distinct() if every else stars.unionByName(found.select("a", "b"))

    # groups are already joined within; what is left joins their roots
    if every:
        root_of = lambda c: linked.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        between = links.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    else:
        between = found.select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
    above = cut(components(between))
    named = sets.select("sid", "sig", "rep").join(linked.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    named = named.join(above.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").withColumn("root", F.coalesce("top", "root")).drop("top")
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_set = cut(named.join(least, "root").select("sig", "sid", "component_id"))
    out = rows.select("doc_id", "text_hash", "n", "sig").join(of_set, "sig", "left")
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), "sid"), links


def digest(members: DataFrame) -> DataFrame:
    return members.select("doc_id", "n_shingles", "component_id")


def representatives(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, one of least doc_id (of several rows with that id the one whose text hashes least), with docs' own columns.

    Rows are told apart by doc_id and text, so ids may repeat; rows without doc_id and texts without shingles all stay.
    An empty table stays empty.
    """
    members, _ = link(docs, width, percent)
    rows = cut(members.filter("sid is not null and doc_id is not null").select("doc_id", "text_hash", "component_id", "sid"))
    place = F.struct("doc_id", "text_hash")
    least = rows.groupBy("component_id").agg(F.min(place).alias("first"))
    marked = rows.join(least, "component_id")
    gone = cut(marked.filter(place != F.col("first")).select(F.col("doc_id").alias("id_"), F.col("text_hash").alias("hash_")).distinct())
    few = F.broadcast if gone.count() <= BROADCAST_IDS else lambda df: df
    same = lambda df: (F.col("doc_id").cast("long") == df["id_"]) & (F.xxhash64(F.coalesce("text", F.lit(""))) == df["hash_"])
    left = docs.join(few(gone), same(gone), "left_anti")
    again = cut(marked.filter(place == F.col("first")).groupBy(F.col("doc_id").alias("id_"), F.col("text_hash").alias("hash_")).agg(F.count("*").alias("n_")).filter("n_ > 1").select("id_", "hash_"))
    if again.isEmpty():
        return left
    once = left.join(again, same(again), "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(again, same(again), "left_anti").unionByName(once)
