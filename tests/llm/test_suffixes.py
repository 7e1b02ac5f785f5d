import hashlib
import random

import numpy as np
import pytest

from ledgerline.llm import suffixes


def brute(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d in data:
        for i in range(len(d) - length + 1):
            w = d[i : i + length]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(d)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(d, gone) if not g)).hexdigest()))
    return out


def check(spark, texts, piece=None, buckets=None, monkeypatch=None):
    if piece:
        monkeypatch.setattr(suffixes, "PIECE_BYTES", piece)
        monkeypatch.setattr(suffixes, "BUCKET_BYTES", buckets)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, rid int").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.digest(suffixes.dedup(docs)).collect()}
    want = brute(texts)
    bad = [i for i in range(len(texts)) if got[i] != want[i]]
    assert not bad, [(got[i], want[i]) for i in bad[:3]]
    return sum(w[1] for w in want)


def make(seed, n):
    rng = random.Random(seed)
    letters = "abcdeé😀 \n"
    text = lambda k: "".join(rng.choice(letters) for _ in range(k))
    shared = [text(k) for k in (150, 199, 200, 201, 260, 500, 1200)]
    out = []
    for _ in range(n):
        parts = [rng.choice(shared)[rng.randrange(0, 40) :] if rng.random() < 0.5 else text(rng.randrange(0, 300)) for _ in range(rng.randrange(0, 7))]
        out.append("".join(parts))
    return out + [out[0], out[1], out[1]]


def test_random_texts(spark):
    assert check(spark, make(1, 60)) > 5000


def test_small_pieces(spark, monkeypatch):
    assert check(spark, make(2, 60), 3000, 3000, monkeypatch) > 5000


def test_odd_texts(spark):
    assert check(spark, [None, "", "a" * 199, "b" * 200, "c" * 201, "ab" * 300, "xyz" * 1000, "q" * 150 + "é" * 400, "same " * 40, "same " * 40, "S" + "same " * 39 + "same"]) > 1000


def test_empty(spark):
    assert suffixes.digest(suffixes.dedup(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


@pytest.mark.parametrize("length", [200])
def test_very_long_text(spark, length):
    rng = random.Random(4)
    part = "".join(rng.choice("abcdefgh") for _ in range(3000))
    body = "".join(rng.choice("abcdefgh") for _ in range(9_000_000))
    at = (1 << 22) - 1000
    long = body[:at] + part + body[at:]
    got = {r.doc_id: r for r in suffixes.digest(suffixes.dedup(spark.createDataFrame([(0, long), (1, part)], "doc_id long, text string"))).collect()}
    assert (got[0].n_removed, got[0].n_spans, got[1].n_removed) == (3000, 1, 3000)
    assert got[0].kept_sha256 == hashlib.sha256(body.encode()).hexdigest()


def test_ids_are_stored(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(1, "x" * 500), (2, "y")], "doc_id long, text string").write.parquet(path)
    plan = suffixes.dedup(spark.read.parquet(path))._jdf.queryExecution().optimizedPlan().toString()
    assert "monotonically_increasing_id" not in plan


def test_a_common_footer_is_dealt_on(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT_WINDOWS", 3000)
    monkeypatch.setattr(suffixes, "SHARE", 1)
    seen = []
    hot = suffixes._hot
    monkeypatch.setattr(suffixes, "_hot", lambda docs, length: seen.append(hot(docs, length)) or seen[-1])
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefghé") for _ in range(n))
    footer = word(150)
    texts = [word(rng.randrange(60, 200)) + footer + word(rng.randrange(0, 90)) for _ in range(120)]
    texts += [texts[3], "more " + texts[4], texts[5][40:] + "!", None, "short"]
    assert check(spark, texts) > 1000
    assert seen[0] and all(h.n >= 3000 for h in seen[0])


def test_a_large_bucket_is_compared_by_fingerprints(monkeypatch):
    rng = np.random.default_rng(3)
    body = rng.integers(0, 3, 4000).astype(np.uint8)
    body[2000:2300] = body[100:400]
    raw = np.concatenate([body, body[500:900], rng.integers(0, 250, 800).astype(np.uint8)])
    sizes = np.array([4000, 400, 800])
    starts, windows, pos = np.cumsum(sizes) - sizes, sizes - 199, np.array([7, 0, 2])
    usual = suffixes.repeats(raw, starts, windows, pos, 200)
    monkeypatch.setattr(suffixes, "LARGE_BUCKET", 10)
    other = suffixes.repeats(raw, starts, windows, pos, 200)
    pairs = lambda found: sorted(zip(*map(list, found)))
    assert pairs(usual) == pairs(other) and len(usual[0]) > 300
