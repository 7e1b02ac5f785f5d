import random
import re

from ledgerline.llm import jaccard


def brute(rows, width, percent):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and rows[a][0] is not None and rows[b][0] is not None and 100 * both >= percent * len(sets[a] | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted((-1 if i is None else i, len(sets[k]), -1 if i is None else least[find(k)]) for k, (i, _) in enumerate(rows))


def make(n, seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    common = [rng.choice(words) for _ in range(12)]
    base = [[rng.choice(words) for _ in range(rng.randrange(20, 160))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = rng.choice(words)
        if rng.random() < 0.3:
            at = rng.randrange(len(w))
            w[at:at] = common
        text = "\t".join(w) if i % 5 == 0 else " ".join(w)
        rows.append((i * 3 + 1, text.upper() if i % 7 == 0 else text))
    rng.shuffle(rows)
    return rows


def run(spark, rows, width, percent):
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, sid int").repartition(3)
    members, _ = jaccard.link(df, width, percent)
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in jaccard.digest(members).collect())


def test_components_match_brute_force(spark):
    rows = make(220, 1) + [(5000, None), (5001, ""), (5002, " \n"), (5003, "One two"), (5004, "one TWO"), (5005, "é É"), (5006, "é é"), (None, "one two"), (5007, "x y z"), (5008, "rep " * 20_000), (5009, "rep " * 19_000)]
    want = brute(rows, 4, 85)
    assert run(spark, rows, 4, 85) == want
    assert len({c for _, _, c in want}) < 200


def test_other_parameters(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PART_TOKENS", 300)
    monkeypatch.setattr(jaccard, "ASK_TOKENS", 400)
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 0)
    rows = make(90, 2)
    assert run(spark, rows, 5, 80) == brute(rows, 5, 80)


def test_empty(spark):
    assert run(spark, [], 4, 85) == []


def test_every_link(spark):
    base = [f"b{k}" for k in range(150)]
    rows = make(60, 4) + [(1000 + i, " ".join([*base[: 10 * i], "odd", *base[10 * i + 1 :]])) for i in range(12)]
    members, links = jaccard.link(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, every=True)
    of_sid, sets = {}, {}
    for r in members.filter("sid is not null").collect():
        of_sid.setdefault(r.sid, r.doc_id)
    for i, t in rows:
        w = t.lower().split()
        sets[i] = frozenset(tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3)))
    own = sorted(set(sets.values()), key=sorted)
    want = {frozenset((x, y)) for k, x in enumerate(own) for y in own[:k] if 100 * len(x & y) >= 85 * len(x | y)}
    got = [frozenset((sets[of_sid[r.a]], sets[of_sid[r.b]])) for r in links.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) >= 66
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.digest(members).collect()) == brute(rows, 4, 85)


def test_words_that_collide_under_polynomial_hashes(spark):
    one = two = "a"
    for _ in range(11):
        one, two = one + one.translate({97: 98, 98: 97}), two + two.translate({97: 98, 98: 97})
    two = one.translate({97: 98, 98: 97})
    assert run(spark, [(1, one), (2, two), (3, one)], 4, 85) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]


def test_a_large_group_of_near_copies_is_linked_by_a_forest(spark):
    rng = random.Random(6)
    base = [f"b{k}" for k in range(200)]
    rows = [(i, " ".join(w if rng.random() > 0.012 else f"x{i}y{k}" for k, w in enumerate(base))) for i in range(400)]
    members, links = jaccard.link(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.digest(members).collect()) == brute(rows, 4, 85)
    assert links.count() < 2 * len(rows)


def test_representatives_by_row_not_by_id(spark):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(1, a, 0), (7, a + " more", 1), (7, b, 2), (7, b, 3), (8, b + " more", 4), (None, a, 5), (9, None, 6), (9, "", 7), (9, None, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sid int").repartition(3)
    got = jaccard.representatives(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id or -1), (r.text or "")[:2]) for r in got.collect()) == [(-1, "a0"), (1, "a0"), (7, "b0"), (9, ""), (9, ""), (9, "")]
    assert jaccard.representatives(docs.limit(0)).count() == 0
