"""Exact substring dedup by blockwise suffix sorting with a difference cover.

Two windows of LENGTH equal bytes have the same anchor: the least hash of GRAM bytes in them. Windows are therefore
dealt to suffix buckets by their anchor, a run of windows with one anchor as one piece of text, and each bucket is
sorted alone. Windows of an anchor that very many others share are dealt on by a second key that equal windows share, the
fingerprint of the whole window, so no anchor fills a task. In a bucket the strings at a difference cover's positions (residues 0 and 1 modulo 3)
are ranked first. Any two windows have an offset of two bytes at most at which both meet the cover, so a window
is sorted by that rank and the one or two bytes the ranked string leaves out, never by comparing long ties.
Windows next to each other with equal keys are repeats.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, small_batches, tidy

LENGTH = 200
GRAM = 16
#: Bytes of text a map step works on at once, and bytes of pieces a bucket should hold.
PIECE_BYTES = 5 << 19
BUCKET_BYTES = 5 << 20
#: Windows of one anchor from which they are dealt on, of one bucket from which it is sorted by fingerprints alone, anchors at most that
#: are dealt on (the most common ones, by a share of all texts; others are sorted where they are, whatever their number).
HOT_WINDOWS, LARGE_BUCKET, HOT_ANCHORS, SHARE = 1 << 20, 1 << 22, 1 << 20, 16
#: The cover: residues modulo 3 whose differences are all residues.
COVER, MODULUS = (0, 1), 3
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 2**64)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = n + (n >> 3)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.ones(size, np.uint64)
            p[1:] = np.uint64(base)
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


class Prints:
    """Fingerprints (64 bits) of any substrings of one byte array."""

    def __init__(self, raw: np.ndarray):
        up, self.down = _power(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.sums[1:])

    def of(self, at: np.ndarray, size) -> np.ndarray:
        h = (self.sums[at + size] - self.sums[at]) * self.down[at]
        h = (h ^ (h >> np.uint64(31))) * _MIX
        return h ^ (h >> np.uint64(29))

    def all(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        h = (self.sums[size:] - self.sums[:n]) * self.down[:n]
        h = (h ^ (h >> np.uint64(31))) * _MIX
        return h ^ (h >> np.uint64(29))


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All of start, start + 1, ... for each start and size, one after the other."""
    sizes = sizes.astype(np.int64)
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(sizes) - sizes
    return np.arange(total) + np.repeat(starts - before, sizes)


def _runs(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, prints: Prints, length: int) -> tuple[np.ndarray, ...]:
    """(start, windows, anchor's hash, owner) of each run of windows with one anchor; windows lie within one text."""
    span = length - GRAM + 1
    least = prints.all(GRAM) & ~np.uint64((1 << 24) - 1) | np.arange(len(raw) - GRAM + 1, dtype=np.uint64)
    width = 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    long = np.flatnonzero(sizes >= length)
    at = _spread(starts[long], sizes[long] - length + 1)
    owner = np.repeat(long, sizes[long] - length + 1)
    anchor = least[at]
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])])) if len(at) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate([new, [len(at)]]))
    gram = prints.of((anchor[new] & np.uint64((1 << 24) - 1)).astype(np.int64), GRAM)
    return at[new], count, gram, owner[new]


class Squeeze:
    """Compression of small blobs with a sample of the texts as dictionary."""

    def __init__(self, sample: bytes, level: int = 9):
        held = zstandard.ZstdCompressionDict(sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(sample) >= 8 else None
        if held:
            held.precompute_compress(level=level)
        self.pack = zstandard.ZstdCompressor(level=level, dict_data=held).compress
        self.unpack = zstandard.ZstdDecompressor(dict_data=held).decompress


@lru_cache(maxsize=2)
def _squeeze(sample: bytes) -> Squeeze:
    return Squeeze(sample)


def _pack(raw: np.ndarray, squeeze: Squeeze, **columns: np.ndarray) -> bytes:
    head = np.array([len(columns["rid"]), len(raw)], np.int64).tobytes()
    return squeeze.pack(head + b"".join(c.tobytes() for c in columns.values()) + raw.tobytes())


def _unpack(blob: bytes, squeeze: Squeeze) -> tuple[np.ndarray, ...]:
    data = squeeze.unpack(blob)
    n, size = np.frombuffer(data, np.int64, 2).tolist()
    rid = np.frombuffer(data, np.int64, n, 16)
    pos, windows = (np.frombuffer(data, np.int32, n, 16 + 8 * n + 4 * n * k) for k in range(2))
    gram = np.frombuffer(data, np.uint64, n, 16 + 16 * n)
    return rid, pos, windows, gram, np.frombuffer(data, np.uint8, size, 16 + 24 * n)


def _steps(batches: Iterator[pd.DataFrame], length: int) -> Iterator[tuple[list[bytes], np.ndarray, int]]:
    """(texts, rids, shift) of some MB at a time. One very long text comes in overlapping parts, so that a place fits its 24 bits;
    shift is where the part begins."""
    for batch in batches:
        data = [t.encode("utf-8", "surrogatepass") for t in batch["text"]]
        rids = batch["rid"].to_numpy(np.int64)
        at = 0
        while at < len(data):
            end, size = at, 0
            while end < len(data) and (end == at or size + len(data[end]) <= PIECE_BYTES):
                size += len(data[end])
                end += 1
            if size >= 1 << 23:
                for i in range(0, size - length + 1, 1 << 22):
                    yield [data[at][i : i + (1 << 22) + length - 1]], rids[at:end], i
            elif max(map(len, data[at:end])) >= length:
                yield data[at:end], rids[at:end], 0
            at = end


def _anchors(batches: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """(gram, n): anchors with their windows, summed up for each step."""
    for data, _, _ in _steps(batches, length):
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        raw = np.frombuffer(b"".join(data), np.uint8)
        _, count, gram, _ = _runs(raw, np.cumsum(sizes) - sizes, sizes, Prints(raw), length)
        value, inverse = np.unique(gram, return_inverse=True)
        n = np.bincount(inverse, weights=count).astype(np.int64)
        often = n > length  # an anchor of many windows has some in most steps that hold it
        yield pd.DataFrame({"gram": value[often].view(np.int64), "n": n[often]})
    tidy()


def _deal(batches: Iterator[pd.DataFrame], buckets: int, hot: np.ndarray, hot_buckets: int, length: int, sample: bytes) -> Iterator[pd.DataFrame]:
    """Pieces by bucket (kind 0), the spans that already repeat within what a step reads (kind 1), and windows of hot anchors by
    their own fingerprints (kind 2) in buckets behind the others."""
    for data, rids, shift in _steps(batches, length):
        yield _deal_piece(data, rids, buckets, hot, hot_buckets, length, _squeeze(sample)).assign(shift=shift)
    _powers.clear()
    tidy()


def _deal_piece(data: list[bytes], rids: np.ndarray, buckets: int, hot: np.ndarray, hot_buckets: int, length: int, squeeze: Squeeze) -> pd.DataFrame:
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    raw = np.frombuffer(b"".join(data), np.uint8)
    starts = np.cumsum(sizes) - sizes
    prints = Prints(raw)
    at, count, gram, owner = _runs(raw, starts, sizes, prints, length)
    pos = (at - starts[owner]).astype(np.int32)
    rows: list[tuple[int, int, bytes]] = []
    if len(hot):
        apart = np.isin(gram, hot)
        rows += _deal_windows(at[apart], count[apart], rids[owner[apart]], pos[apart], prints, buckets, hot_buckets, length, squeeze)
        at, count, gram, owner, pos = (c[~apart] for c in (at, count, gram, owner, pos))
    if not len(at):
        return pd.DataFrame(rows, columns=["bucket", "kind", "payload"])
    content = prints.of(at, count + length - 1) + count.astype(np.uint64) * _MIX
    _, first, inverse, n = np.unique(content, return_index=True, return_inverse=True, return_counts=True)
    many = n[inverse] > 1
    if many.any():
        spans = np.stack([rids[owner[many]], pos[many].astype(np.int64), pos[many] + count[many] + length - 1]).astype(np.int64)
        rows.append((int(gram[0] % np.uint64(buckets)), 1, squeeze.pack(spans.tobytes())))
    bucket = (gram[first] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    kept, bucket = first[order], bucket[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
    for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        k = kept[low:high]
        # a piece that repeats here needs no answer, which a rid of -1 says
        rid = np.where(many[k], -1, rids[owner[k]])
        rows.append((int(bucket[low]), 0, _pack(raw[_spread(at[k], count[k] + length - 1)], squeeze, rid=rid, pos=pos[k], windows=count[k].astype(np.int32), gram=gram[k])))
    return pd.DataFrame(rows, columns=["bucket", "kind", "payload"])


def _deal_windows(at: np.ndarray, count: np.ndarray, rids: np.ndarray, pos: np.ndarray, prints: Prints, buckets: int, hot_buckets: int, length: int, squeeze: Squeeze) -> list[tuple[int, int, bytes]]:
    """Windows one by one. Those that repeat within the step are answered, and one of them goes on, to answer others."""
    if not len(at):
        return []
    window = prints.of(_spread(at, count), length)
    rid = np.repeat(rids, count)
    place = _spread(pos.astype(np.int64), count)
    _, first, inverse, n = np.unique(window, return_index=True, return_inverse=True, return_counts=True)
    many = n[inverse] > 1
    rows = []
    if many.any():
        rows.append((buckets + int(window[0] % np.uint64(hot_buckets)), 1, squeeze.pack(np.stack(_joined(rid[many], place[many], length)).tobytes())))
    bucket = (window[first] % np.uint64(hot_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    kept, bucket = first[order], bucket[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
    for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        k = kept[low:high]
        rows.append((buckets + int(bucket[low]), 2, squeeze.pack(np.stack([window[k].view(np.int64), np.where(many[k], -1, rid[k]), place[k]]).tobytes())))
    return rows


def _joined(rid: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(rid, start, end) of spans that windows next to each other make up."""
    order = np.lexsort((place, rid))
    rid, place = rid[order], place[order]
    new = np.concatenate([[True], (np.diff(rid) != 0) | (np.diff(place) > 1)])
    low = np.flatnonzero(new)
    high = np.concatenate([low[1:], [len(rid)]]) - 1
    return rid[low], place[low], place[high] + length


def _equal(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice


def repeats(raw: np.ndarray, starts: np.ndarray, windows: np.ndarray, pos: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(window's piece, window's offset in it) of all windows of the pieces that occur more than once among them."""
    prints = Prints(raw)
    sizes = windows.astype(np.int64) + length - 1
    if windows.sum() > LARGE_BUCKET:
        at = _spread(starts, windows)
        hit = np.flatnonzero(_equal(prints.of(at, length)))
        piece = np.repeat(np.arange(len(starts)), windows)[hit]
        return piece, at[hit] - starts[piece]
    ranked = length - MODULUS + 1
    # cover sample: ranks of the strings at positions of the cover
    span = _spread(starts, sizes - ranked + 1)
    residue = ((span - np.repeat(starts - pos, sizes - ranked + 1)) % MODULUS).astype(np.int8)
    sample = span[np.isin(residue, COVER)]
    del span, residue
    rank = np.zeros(len(raw) + 1, np.uint64)
    _, inverse = np.unique(prints.of(sample, ranked), return_inverse=True)
    rank[sample] = inverse.astype(np.uint64)
    del prints, sample, inverse
    # suffixes of the bucket, each by the cover's rank near it and the bytes that rank leaves out
    at = _spread(starts, windows)
    piece = np.repeat(np.arange(len(starts)), windows)
    residue = (at - np.repeat(starts - pos, windows)) % MODULUS
    bits = np.uint64(max(1, int(len(at)).bit_length()))
    keys = []
    for c in COVER:
        d = (c - residue) % MODULUS
        one = np.where(d >= 1, raw[at], raw[at + length - 2]).astype(np.uint64)
        two = np.where(d >= 2, raw[at + 1], raw[at + length - 1]).astype(np.uint64)
        key = rank[at + d] << np.uint64(18) | d.astype(np.uint64) << np.uint64(16) | one << np.uint64(8) | two
        keys.append(key << bits | np.arange(len(at), dtype=np.uint64))
    key = np.concatenate(keys)
    del keys
    key.sort()
    same = (key[1:] >> bits) == (key[:-1] >> bits)
    index = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    twice = np.zeros(len(at), bool)
    twice[index[1:][same]] = True
    twice[index[:-1][same]] = True
    hit = np.flatnonzero(twice)
    return piece[hit], at[hit] - starts[piece[hit]]


def _sort_bucket(rows: pd.DataFrame, length: int, sample: bytes) -> pd.DataFrame:
    found, parts, alone, squeeze = [], [], [], _squeeze(sample)
    for kind, shift, payload in zip(rows["kind"], rows["shift"], rows["payload"], strict=True):
        if kind == 1:
            rid, start, end = np.frombuffer(squeeze.unpack(payload), np.int64).reshape(3, -1)
            found.append((rid, start + shift, end + shift))
        elif kind == 2:
            window, rid, place = np.frombuffer(squeeze.unpack(payload), np.int64).reshape(3, -1)
            alone.append((window, rid, place + shift))
        else:
            rid, pos, windows, gram, raw = _unpack(payload, squeeze)
            parts.append((rid, pos.astype(np.int64) + shift, windows.astype(np.int64), gram, raw))
    if parts:
        rid, pos, windows, gram, raw = (np.concatenate([p[k] for p in parts]) for k in range(5))
        starts = np.cumsum(windows + length - 1) - (windows + length - 1)
        _, inverse, n = np.unique(gram, return_inverse=True, return_counts=True)
        asked = np.bincount(inverse, weights=rid >= 0)
        keep = np.flatnonzero((n[inverse] > 1) & (asked[inverse] > 0))
        if len(keep):
            raw = raw[_spread(starts[keep], windows[keep] + length - 1)]
            rid, pos, windows = rid[keep], pos[keep], windows[keep]
            starts = np.cumsum(windows + length - 1) - (windows + length - 1)
            piece, offset = repeats(raw, starts, windows, pos, length)
            want = rid[piece] >= 0
            piece, offset = piece[want], offset[want]
            if len(piece):
                new = np.concatenate([[True], (np.diff(piece) != 0) | (np.diff(offset) != 1)])
                low = np.flatnonzero(new)
                high = np.concatenate([low[1:], [len(piece)]]) - 1
                found.append((rid[piece[low]], pos[piece[low]] + offset[low], pos[piece[low]] + offset[high] + length))
    if alone:
        window, rid, place = (np.concatenate([a[k] for a in alone]) for k in range(3))
        hit = _equal(window) & (rid >= 0)
        if hit.any():
            found.append(_joined(rid[hit], place[hit], length))
    # workers outlive their tasks: what a bucket needed is given back before the next one comes
    _powers.clear()
    tidy()
    out = [np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3)]
    return pd.DataFrame({"rid": out[0], "start": out[1], "end": out[2]})


def _sample(docs: DataFrame) -> bytes:
    """Some text for the compressor's dictionary: it changes sizes of what is shuffled and nothing else."""
    return "".join(r.t for r in docs.select(F.substring("text", 1, 2000).alias("t")).limit(50).collect()).encode("utf-8", "surrogatepass")


def repeated_spans(docs: DataFrame, length: int = LENGTH, share: DataFrame | None = None) -> DataFrame:
    """(rid, start, end): byte spans of texts made of strings of so many bytes that also start elsewhere. Spans may overlap.

    docs: rid (unique long), text (never null). Equality is by 64-bit fingerprints within a bucket. Anchors with very many
    windows are found by a count over share, one in SHARE of docs, before windows are dealt; a bucket that is large all the same is
    compared by fingerprints alone, so none is too large.
    """
    sample = docs.sparkSession.sparkContext.broadcast(_sample(docs))
    total = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    # a window of 185 grams changes its anchor about every 93 bytes, so pieces hold about 3.2 times the text
    buckets = max(1, int(total * 3.2 / BUCKET_BYTES))
    long = docs.filter(F.octet_length("text") >= length)
    hot = _hot(_share(docs) if share is None else share, length)
    shared = docs.sparkSession.sparkContext.broadcast((sample.value, np.array([h.gram for h in hot], np.int64).view(np.uint64)))
    hot_buckets = max(1, int(sum(h.n for h in hot) * 24 / BUCKET_BYTES))
    dealt = long.mapInPandas(lambda it: _deal(it, buckets, shared.value[1], hot_buckets, length, shared.value[0]), "bucket int, kind int, payload binary, shift long")
    return dealt.groupBy("bucket").applyInPandas(lambda rows: _sort_bucket(rows, length, sample.value), "rid long, start long, end long")


def _share(rows: DataFrame) -> DataFrame:
    return rows.filter(F.pmod(F.xxhash64("rid"), F.lit(SHARE)) == 0)


def _hot(share: DataFrame, length: int) -> list:
    """(gram, n): anchors of HOT_WINDOWS windows or more by the count in a share of the texts, the commonest HOT_ANCHORS at most.

    Which anchors are found changes where windows are compared and never what is found.
    """
    n = (F.sum("n") * SHARE).alias("n")
    return share.mapInPandas(lambda it: _anchors(it, length), "gram long, n long").groupBy("gram").agg(n).filter(F.col("n") >= HOT_WINDOWS).orderBy(F.desc("n"), "gram").limit(HOT_ANCHORS).collect()


def dedup(docs: DataFrame, length: int = LENGTH, text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept): one row for each row of docs; spans: maximal removed byte spans; kept: the other bytes.

    A byte is removed if a string of `length` bytes that covers it also starts anywhere else, in the same text or
    another. Texts are UTF-8 bytes, null is empty; texts shorter than length keep all. Repeated rows and null ids are
    rows like any other. Rows are known by an id that is written with their packed text.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sample = docs.sparkSession.sparkContext.broadcast(_sample(rows))

    def squeezed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = _squeeze(sample.value).pack
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "packed": [pack(t.encode("utf-8", "surrogatepass")) for t in batch["text"]]})
        tidy()

    def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = _squeeze(sample.value).unpack
        for batch in batches:
            yield pd.DataFrame({"rid": batch["rid"], "text": [unpack(p).decode("utf-8", "surrogatepass") for p in batch["packed"]]})
        tidy()

    packed = numbered(rows.mapInPandas(squeezed, "doc_id long, packed binary"))
    texts = lambda rows: rows.select("rid", "packed").mapInPandas(unpacked, "rid long, text string")
    spans = repeated_spans(texts(packed), length, texts(_share(packed))).groupBy("rid").agg(F.collect_list(F.struct("start", "end")).alias("found"))

    @F.pandas_udf("struct<n_bytes:long,spans:array<struct<start:long,end:long>>,kept:binary>")
    def without(packed: pd.Series, found: pd.Series) -> pd.DataFrame:
        out = []
        unpack = _squeeze(sample.value).unpack
        for p, f in zip(packed, found, strict=True):
            data = unpack(p)
            if f is None or not len(f):
                out.append((len(data), [], data))
                continue
            merged: list[list[int]] = []
            for a, b in sorted((s["start"], s["end"]) for s in f):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            kept, low = [], 0
            for a, b in merged:
                kept.append(data[low:a])
                low = b
            out.append((len(data), [{"start": a, "end": b} for a, b in merged], b"".join([*kept, data[low:]])))
        return pd.DataFrame(out, columns=["n_bytes", "spans", "kept"])

    return packed.join(spans, "rid", "left").select("doc_id", without("packed", "found").alias("x")).select("doc_id", "x.*")


def digest(deduped: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return deduped.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
