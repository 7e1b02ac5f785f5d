import math
import random

from ledgerline.llm import decontaminate as dc


def brute(text, items):
    """Score every passage against every item without pruning."""
    items = [(i, t, dc.words(t)) for i, t in items if t]
    n, avg = len(items), sum(len(w) for *_, w in items) / len(items)
    df = {}
    for *_, w in items:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    w = dc.words(text)
    step = max(dc.LEAST_PASSAGE, max(len(x) for *_, x in items))
    out = set()
    for s in range(0, max(1, len(w) - step), step):
        passage = w[s : s + 2 * step]
        near = {tuple(passage[i : i + k]) for k in range(1, dc.RUN + 1) for i in range(len(passage) - k + 1)}
        for i, t, own in items:
            imp = {x: math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * own.count(x) * (dc.K1 + 1) / (own.count(x) + dc.K1 * (1 - dc.B + dc.B * len(own) / avg)) for x in set(own)}
            score = sum(v for x, v in imp.items() if x in set(passage)) / sum(imp.values())
            q, a = dc.question_and_answer(t)
            over = [len(dc.runs(p) & near) / len(dc.runs(p)) if p else 1.0 for p in (q, a)]
            if score >= dc.SHARE and min(over) >= dc.OVERLAP:
                out.add((i, round(0, 6)))
    return {i for i, _ in out}


def test_matches_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(300)] + ["the"] * 200
    sentence = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, f"{sentence(12)}. {sentence(10)}.\n{sentence(8)}.") for i in range(40)] + [(50, "only four words here"), (51, "odd"), (52, ""), (53, None)]
    texts = [None, "", sentence(500)]
    for i, t in items[:20]:
        body = sentence(150).split()
        at = rng.randrange(150)
        lost = t.upper().replace(" ", "!! ", 3) if i % 3 else " ".join(t.split()[: 20 - i % 5])
        texts.append(" ".join(body[:at]) + " " + lost + " " + " ".join(body[at:]))
    texts += [items[3][1] + " " + items[7][1], "x " * 30_000 + items[5][1], "so only four words here too", texts[4]]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)] + [(None, texts[5], 0)], "doc_id long, text string, item_id long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got: dict = {}
    for r in dc.contaminated(docs, bench).collect():
        got.setdefault(r.doc_id, set()).add(r.item_id)
    want = {i: b for i, t in enumerate(texts) if (b := brute(t or "", items))}
    assert got.pop(None) == want.get(5)
    assert got == want and len(want) > 10
    assert dc.clean(docs, bench).count() == len(texts) + 1 - len(want) - (5 in want)
    assert dc.contaminated(docs, bench.limit(0)).count() == 0 and dc.contaminated(docs.limit(0), bench).count() == 0


def test_scores_do_not_depend_on_how_items_are_stored(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    seen = []
    for at_once, indexes in ((1024, 16), (8, 3)):
        monkeypatch.setattr(dc, "ITEMS_AT_ONCE", at_once)
        monkeypatch.setattr(dc, "INDEXES_AT_ONCE", indexes)
        seen.append(sorted(map(tuple, dc.contaminated(docs, bench).collect())))
    assert seen[0] == seen[1] and seen[0]
