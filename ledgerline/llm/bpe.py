"""Byte-level BPE with a segment tree over adjacent pair ranks.

Each word is a row of a tree whose leaves hold (rank of the pair that starts here, place); an inner node holds the
smaller of its children, so the root is the leftmost lowest-rank merge. A merge rewrites two leaves and clears one,
and only the nodes above them are computed again. Words of like length form one forest, so that one numpy step
advances them all; a word leaves when its root holds no pair.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidy

#: Fixed value: the word pattern of byte-level BPE.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_RANK = (1 << 16) - 1
#: Words kept with their ids in one Python worker; past it the cache starts anew, which changes time and nothing else.
#: At some 300 bytes a word the cache stays below 50 MB.
CACHE_WORDS = 150_000


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a vocabulary file."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(other)}


class Bpe:
    """Encoder and decoder of one vocabulary file (tokenizers' JSON)."""

    def __init__(self, spec: str):
        model = json.loads(spec)
        vocab = model["model"]["vocab"]
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        self.bytes_of = {i: bytes(back[c] for c in s) for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.said = {i: str(i) for i in self.bytes_of}
        self.byte_id = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.base = 1 << int(max(self.bytes_of)).bit_length()
        pairs = []
        for rank, m in enumerate(model["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            pairs.append((vocab[a] * self.base + vocab[b], rank, vocab[a + b]))
        if len(pairs) > NO_RANK:
            raise ValueError(f"{len(pairs)} merges: ranks from {NO_RANK} on cannot be told from no merge")
        self.merged = np.array([m for _, _, m in pairs], np.int64)
        self.slots = 1 << (4 * len(pairs)).bit_length()
        self.keys, self.ranks = np.full(self.slots + 64, -1, np.int64), np.full(self.slots + 64, NO_RANK, np.int64)
        for key, rank, _ in pairs:
            at = int(self._slot(np.int64(key)))
            while self.keys[at] != -1:
                at += 1
            self.keys[at], self.ranks[at] = key, rank
        low = np.repeat(self.byte_id, 256), np.tile(self.byte_id, 256)
        self.first = self.rank(*low).reshape(256, 256)
        self.words = regex.compile(WORDS)
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.cache: dict[str, tuple[int, str, bytes]] = {}

    def _slot(self, key):
        return (key * 0x9E3779B1 >> 7) & (self.slots - 1)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; NO_RANK where it does not merge."""
        key = a * self.base + b
        at = self._slot(key)
        held = self.keys[at]
        out = np.where(held == key, self.ranks[at], NO_RANK)
        rest = np.flatnonzero((held != key) & (held != -1))
        while rest.size:
            at[rest] += 1
            held = self.keys[at[rest]]
            hit = held == key[rest]
            out[rest[hit]] = self.ranks[at[rest[hit]]]
            rest = rest[~hit & (held != -1)]
        return out

    def forest(self, words: list[bytes]) -> list[list[int]]:
        """Ids of every word; all words have at most as many bytes as the tree has leaves."""
        n, leaves = len(words), 1 << max(0, max(map(len, words)) - 1).bit_length()
        bits = max(1, leaves.bit_length())
        kind = np.int32 if NO_RANK << bits < 2**31 else np.int64
        none = kind(NO_RANK << bits)
        size = np.fromiter(map(len, words), np.int64, n)
        raw = np.zeros((n, leaves), np.uint8)
        inside = np.arange(leaves) < size[:, None]
        raw[inside] = np.frombuffer(b"".join(words), np.uint8)
        ids = np.where(inside, self.byte_id[raw], -1)
        place = np.arange(leaves)
        after = np.where(place + 1 < size[:, None], place + 1, -1).astype(np.int32)
        before = np.broadcast_to((place - 1).astype(np.int32), (n, leaves)).copy()
        tree = np.full((n, 2 * leaves), none, kind)
        rank = self.first[raw[:, :-1], raw[:, 1:]].astype(kind)
        tree[:, leaves:-1] = np.where(inside[:, 1:] & (rank < NO_RANK), rank << bits | place[:-1].astype(kind), none)
        width = leaves
        while width > 1:
            tree[:, width >> 1 : width] = np.minimum(tree[:, width : 2 * width : 2], tree[:, width + 1 : 2 * width : 2])
            width >>= 1
        live = np.flatnonzero(tree[:, 1] < none)
        while live.size:
            root = tree[live, 1]
            at = root & ((1 << bits) - 1)
            gone = after[live, at]
            nxt = after[live, gone]
            left = before[live, at]
            one = self.merged[root >> bits]
            ids[live, at], ids[live, gone] = one, -1
            after[live, at] = nxt
            tree[live, gone + leaves] = none
            some, has = np.flatnonzero(nxt >= 0), np.flatnonzero(left >= 0)
            before[live[some], nxt[some]] = at[some]
            value = np.full(live.size, none, kind)
            value[some] = self._leaf(one[some], ids[live[some], nxt[some]], at[some], bits, kind)
            tree[live, at + leaves] = value
            tree[live[has], left[has] + leaves] = self._leaf(ids[live[has], left[has]], one[has], left[has], bits, kind)
            for rows, node in ((live, gone + leaves), (live, at + leaves), (live[has], left[has] + leaves)):
                height = leaves
                while height > 1:
                    node = node >> 1
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                    height >>= 1
            live = live[tree[live, 1] < none]
        keep = ids >= 0
        flat, ends = ids[keep].tolist(), np.cumsum(keep.sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def _leaf(self, a, b, at, bits, kind):
        """What stands in the leaf of pair (a, b) at a place."""
        rank = self.rank(a, b)
        return np.where(rank < NO_RANK, rank << bits | at, NO_RANK << bits).astype(kind)

    def learn(self, words: set[str]) -> None:
        """Put the words into the cache, by tree size and in blocks of bounded memory."""
        by_size: dict[int, list[str]] = {}
        for w in words:
            by_size.setdefault((len(w.encode("utf-8", "replace")) - 1).bit_length(), []).append(w)
        for bits, some in by_size.items():
            step = max(1, (1 << 19) >> bits)
            for i in range(0, len(some), step):
                block = some[i : i + step]
                for w, ids in zip(block, self.forest([w.encode("utf-8", "replace") for w in block]), strict=True):
                    self.cache[w] = len(ids), ",".join([self.said[i] for i in ids]), b"".join([self.bytes_of[i] for i in ids])

    def pieces(self, text: str) -> list[str]:
        """Words of the text in order; a special token's string is a piece of its own."""
        if self.split is None or not any(s in text for s in self.special):
            return self.words.findall(text)
        return [p for part in self.split.split(text) if part for p in ([part] if part in self.special else self.words.findall(part))]

    def encode(self, texts: list[str]) -> list[list[tuple[int, str, bytes]]]:
        """For each text its pieces as (number of ids, ids joined by commas, bytes)."""
        cut = [self.pieces(t) for t in texts]
        words = set().union(*cut)
        if len(self.cache) + len(words) > CACHE_WORDS:
            self.cache.clear()
        known = self.cache
        known |= {s: (1, str(i), s.encode()) for s, i in self.special.items()}
        self.learn(words - known.keys())
        return [[known[w] for w in some] for some in cut]

    def decode(self, ids: list[int]) -> str:
        """Text of the ids; bytes that are no UTF-8 become U+FFFD, as in the library."""
        return b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _bpe(spec: str) -> Bpe:
    return Bpe(spec)


def spec_of(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string), one row per document.

    Null text is the empty text and has no ids. Texts of any length are encoded whole. The vocabulary file (a few MB,
    fixed) goes to executors with the task, so they need no shared path.
    """
    return _run(docs, tokenizer_path, id_col, text_col, "decoded")


def encode_checked(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, intact boolean): encode() with its ids decoded in the same task; intact: they gave the text again."""
    return _run(docs, tokenizer_path, id_col, text_col, "checked")


def encode_digest(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode() with its ids and decoded text reduced in the same task."""
    return _run(docs, tokenizer_path, id_col, text_col, "digests")


#: What a task can return beside doc_id.
SHAPES = {
    "decoded": "ids array<int>, decoded string",
    "checked": "ids array<int>, intact boolean",
    "digests": "n_tokens long, ids_sha256 string, decoded_sha256 string",
}


def _run(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, shape: str) -> DataFrame:
    small_batches(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(spec_of(tokenizer_path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = _bpe(spec.value)
        for batch in batches:
            texts, at = batch["text"].tolist(), 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars + len(texts[end]) <= 500_000):
                    chars += len(texts[end])
                    end += 1
                out = []
                for text, words in zip(texts[at:end], bpe.encode(texts[at:end]), strict=True):
                    ids = ",".join([w[1] for w in words])
                    if shape == "checked":
                        some = np.array(ids.split(","), np.int32) if ids else np.zeros(0, np.int32)
                        out.append((some, bpe.decode(some.tolist()) == text))
                        continue
                    said = b"".join([w[2] for w in words]).decode("utf-8", "replace")
                    if shape == "digests":
                        out.append((sum([w[0] for w in words]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()))
                    else:
                        out.append((np.array(ids.split(","), np.int32) if ids else np.zeros(0, np.int32), said))
                yield pd.concat([batch[["doc_id"]].iloc[at:end].reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)
                at = end
        # workers live on: the vocabulary and what this task has learned are not kept for other stages
        del bpe
        _bpe.cache_clear()
        tidy()

    names = [column.split()[0] for column in SHAPES[shape].split(", ")]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(run, f"doc_id long, {SHAPES[shape]}")
