import random
import zlib

import pyarrow.parquet as pq

from ledgerline.llm import toxicity

SF = "/root/testdata/sf0.1"


def test_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.digest(docs, labels).toPandas()
    assert len(out) == pq.read_metadata(f"{SF}/documents.parquet").num_rows and out.score.between(0, 1).all()
    assert (out.predicted == (out.score >= 0.3)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(out.doc_id, out.held_out, strict=True))
    both = out[out.held_out].merge(labels.toPandas(), on="doc_id")
    langs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "lang"]).to_pandas()
    print(both.merge(langs, on="doc_id").groupby(["lang", "toxic"]).predicted.agg(["mean", "size"]))
    named = both.merge(langs, on="doc_id")
    assert (named[named.toxic == 1].groupby("lang").predicted.mean() >= 0.5).all()
    yes, no = both[both.toxic == 1], both[both.toxic == 0]
    assert yes.predicted.mean() >= 0.7 and no.predicted.mean() <= 0.05, (yes.predicted.mean(), no.predicted.mean())


def test_odd_rows(spark):
    rows = [(i, "plain words here " * 5, i % 5 == 0) for i in range(40)] + [(100, None, None), (101, "", None), (None, "x" * 300_000, None)]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t, _ in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows if y is not None] + [(None, 1), (7, None)], "doc_id long, toxic int")
    assert toxicity.digest(docs, labels).filter("score between 0 and 1").count() == len(rows)
    assert toxicity.digest(docs, labels.limit(0)).filter("score = 0").count() == len(rows)
    assert toxicity.digest(docs.limit(0), labels).count() == 0


def test_every_typical_word_is_found():
    rng = random.Random(2)
    odd = [f"q{a}{b}zu" for a in "abcdefghijklmno" for b in "abcdefghijklmno"]
    plain = [f"w{i}" for i in range(400)]
    toxic = [" ".join(x for w in rng.sample(odd, 60) for x in (rng.choice(plain), w)) for _ in range(120)]
    ordinary = [" ".join(rng.choices(plain, k=80)) for _ in range(600)]
    assert set(toxicity.typical(toxic, ordinary)) == {w.encode() for w in odd}
    a, b = toxicity.train(toxic, ordinary)
    assert len(a) == len(b) and a != b


def test_copies_count_once():
    rng = random.Random(3)
    plain = [f"w{i}" for i in range(400)]
    text = " ".join(rng.choices(plain, k=80)) + " zyxwvu"
    assert toxicity.typical([text] * 200, [" ".join(rng.choices(plain, k=80)) for _ in range(600)]) == ()


def test_windows_save_where_the_toxic_dictionary_knows_them():
    toxic, ordinary = b"same plain words  grobian  lumpenpack ", b"same plain words  kalender  gartenhaus"
    own = toxicity.Scorer(toxic, ordinary)
    x = own.features(["der grobian sang", "ein LUMPENPACK!", "same plain words", "", "kalender", "x" * 50 + "lumpenpack" + "y" * 100_000])
    assert [r[1] > 0 for r in x] == [True, True, False, False, False, True]


def test_repeated_ids_give_one_model(spark):
    docs = spark.createDataFrame([(i % 60, f"text {i} " + ("oaf dolt " if i % 3 == 0 else "kind good ") * 5) for i in range(120)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    assert toxicity.fit(docs.repartition(5), labels) == toxicity.fit(docs.repartition(3, "text"), labels)


def test_kinds_part_texts_by_their_bytes():
    rng = random.Random(4)
    make = lambda letters: " ".join("".join(rng.choices(letters, k=6)) for _ in range(60))
    texts = [make(letters) for letters in ("abcdefgh", "mnopqrst", "éüßöäñ") for _ in range(40)] + ["", "zzz"]
    toxic = toxicity.np.array([i % 2 for i in range(len(texts))])
    made = toxicity.prints(texts)
    kinds = toxicity.kinds_of(made, toxic)
    own = toxicity.nearest(made, kinds)[:120].reshape(3, 40)
    assert len({tuple(set(r)) for r in own.tolist()}) == 3 and all(len(set(r)) == 1 for r in own.tolist())
    assert len(toxicity.kinds_of(made, toxic * 0 + 1)) == 1


def test_a_text_is_scored_by_the_dictionaries_of_its_kind():
    kinds = toxicity.prints(["grobian lumpenpack kalender", "0123456789"])
    own = toxicity.Scorers(kinds, ((b"same plain words  grobian  lumpenpack ", b"same plain words  kalender  gartenhaus"), (b"0123 456789 ", b"0123 987654 ")))
    texts = ["der grobian sang", "456789 0123", "", "LUMPENPACK " * 3]
    want = [own.each[k].features([t])[0] for k, t in zip((0, 1, 0, 0), texts, strict=True)]
    assert (own.features(texts) == toxicity.np.array(want)).all() and want[0][1] > 0 and want[3][1] > want[0][1]
