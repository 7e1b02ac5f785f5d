import corpus_pipeline as cp
from ledgerline.llm import toxicity
from test_jaccard import brute as near
from test_lines import brute_force as line_brute

SF = "/root/testdata/sf0.001"


def test_each_stage_on_its_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for _, stage in cp.STAGES:
        kept.append(cp.cut(stage(spark, kept[-1], SF)))
    rows = [df.toPandas().sort_values("doc_id").reset_index(drop=True) for df in kept]
    for before, after in zip(rows[:4], rows[1:5], strict=True):
        assert list(after.columns) == list(docs.columns) and set(after.doc_id) <= set(before.doc_id)
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet").filter(~toxicity.held_out()))
    low = toxicity.score(docs, model).filter("score < 0.3").toPandas()
    assert set(rows[1].doc_id) == set(low.doc_id)
    counts = line_brute([t if len(t) < 4000 else None for t in rows[1].text])
    assert len(counts) == len(rows[1])
    want = near(list(zip(rows[2].doc_id, rows[2].text, strict=True)), 5, 80)
    assert sorted(rows[3].doc_id) == sorted(i for i, _, c in want if i == c)
    assert len(rows[5]) == len(rows[4]) and (rows[5].n_tokens == rows[5].ids.map(len)).all()


def test_run(spark):
    out = cp.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids"] and out.count() > 50


EXTRA = ("rid", "score", "n_lines", "n", "root", "grp", "line", "spans", "kept", "ids", "n_tokens", "bucket", "a")


def odd(spark):
    """Rows that every stage has to take: nulls in each column, empty and very long texts, repeats, ties, clashing columns."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = [tuple(r) for r in docs.orderBy("doc_id").limit(25).collect()]
    long_ = "\n".join(f"line {n} of a very long text with its own words {n * n}" for n in range(8000))
    rows = [*some, some[3], some[3], (some[4][0], some[5][1], *some[4][2:]), (None, some[6][1], "en", None, None), (None, None, None, None, None), (10**6, None, "en", "s", 0), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, " \n\n ", None, "s", 4), (10**6 + 3, long_, "en", "s", len(long_)), (10**6 + 4, "x" * 300_000, "en", "s", 300_000), (10**6 + 5, "é😀\x00 \x1f", "en", "s", 5)]
    df = spark.createDataFrame(rows, docs.schema)
    for n, c in enumerate(EXTRA):
        df = df.withColumn(c, cp.F.lit(f"own {n}"))
    return df.repartition(3)


def test_every_stage_takes_odd_rows(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = kept = odd(spark)
    columns = docs.columns
    for name, stage in cp.STAGES:
        before, kept = kept, cp.cut(stage(spark, kept, SF))
        if name == "tokens":
            break
        assert kept.columns == columns, name
        rows = [tuple(r) for r in kept.collect()]
        assert {r[2:4] for r in rows} <= {tuple(r)[2:4] for r in before.collect()} and all(r[5:] == tuple(f"own {n}" for n in range(len(EXTRA))) for r in rows), name
        ids = [r[0] for r in rows]
        # nothing is known against a null, an empty or a blank text, or against the row of a clean long one
        assert ids.count(None) >= 1 and {10**6, 10**6 + 1, 10**6 + 2, 10**6 + 3, 10**6 + 4} <= set(ids), name
        if name == "near_copies":
            assert ids.count(some_id(docs)) == 1
    last = {(r.doc_id, r.text) for r in before.collect()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.no_padding()
    tokenizer.no_truncation()
    want = sorted((i if i is not None else -1, tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in last)
    assert sorted((r.doc_id if r.doc_id is not None else -1, list(r.ids)) for r in kept.dropDuplicates(["doc_id", "ids"]).collect()) == want
    assert all(r.n_tokens == len(r.ids) for r in kept.collect())


def some_id(docs):
    """The id of the row that stands there three times."""
    return docs.groupBy("doc_id", "text").count().filter("count = 3").first().doc_id


def test_every_stage_takes_an_empty_table(spark):
    empty = odd(spark).limit(0)
    for name, stage in cp.STAGES:
        out = stage(spark, empty, SF)
        assert out.isEmpty() and (name == "tokens" or out.columns == empty.columns), name


def test_decontamination_finds_what_holds_an_item(spark):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(6).collect()
    filler = "entirely other words stand here and tell of rivers hills and weather "
    rows = [(n, filler * 3 + (r.text if n % 2 else "") + " " + filler * 2, "en", "s", 0) for n, r in enumerate(items)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    assert sorted(r.doc_id for r in cp.drop_contaminated(spark, docs, SF).collect()) == [0, 2, 4]


def test_tokens_are_decoded_and_compared_with_their_text(spark, tmp_path, monkeypatch):
    """In this vocabulary two letters share an id, so texts with the one or the other cannot both come back."""
    import json

    import public_tokenizers
    import pytest

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    vocab = spec["model"]["vocab"]
    spec["model"]["merges"], vocab["Q"] = [], vocab["X"]
    (tmp_path / "shared.json").write_text(json.dumps(spec), encoding="utf-8")
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    plain = spark.createDataFrame([(1, "plain é😀 words", "en", "s", 0), (2, None, "en", "s", 0), (3, "", "en", "s", 0)], schema)
    mixed = plain.union(spark.createDataFrame([(4, "Q and X", "en", "s", 0)], schema))
    assert [r.n_tokens for r in cp.to_tokens(spark, mixed, SF).orderBy("doc_id").collect()][1:] == [0, 0, 3]
    monkeypatch.setattr(cp, "tokenizer_path", lambda: str(tmp_path / "shared.json"))
    assert sorted(r.doc_id for r in cp.to_tokens(spark, plain, SF).collect()) == [1, 2, 3]
    with pytest.raises(Exception, match="ids do not decode to the text of doc_id 4"):
        cp.to_tokens(spark, mixed, SF).collect()
