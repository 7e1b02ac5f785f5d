import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import fingerprints as fp


def brute(rows):
    """doc_id -> (edited text) by a loop over documents in descending order."""
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: -r[0])
    out = {}
    for n, (i, t) in enumerate(order):
        half = len(t) // 2
        out[i] = t[: len(t) - half] + order[(n + 1) % len(order)][1][:half]
    return out


def test_edited_texts_and_equal_roots(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeélrtß 日") for _ in range(rng.randint(1, 12)))
    rows = [(i, rng.choice([" ", "\n", "\n\n", ""]).join(word() for _ in range(rng.randint(0, 400)))) for i in range(60)] + [(70, None), (71, ""), (72, rows_text := "x" * 300_000), (73, rows_text), (-4, "\n\n\n"), (1 << 62, "end")]
    docs = spark.createDataFrame([(i, t, "a") for i, t in rows], "doc_id long, text string, fingerprint string").repartition(5)
    got = {r.doc_id: r for r in fp.digest(fp.changed(docs)).collect()}
    want = brute(rows)
    assert len(got) == len(rows)
    by_root: dict = {}
    for i, t in rows:
        r = got[i]
        assert r.n_chars == len(t or "") and r.edited_sha256 == hashlib.sha256(want[i].encode()).hexdigest()
        assert (r.near_edited == 1) == (want[i] == (t or "")) and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by_root.setdefault(r.fingerprint, set()).add(t or "")
    assert all(len(v) == 1 for v in by_root.values()) and got[72].fingerprint == got[73].fingerprint


def test_ties_nulls_repeats_and_empty_tables(spark):
    schema = "doc_id long, text string, k string, h string"
    assert fp.digest(fp.changed(spark.createDataFrame([], schema))).count() == 0
    rows = [(5, "five five", "", ""), (5, "five five", "", ""), (5, "other text", "", ""), (None, "nameless", "", ""), (None, None, "", ""), (0, "zero", "", "")]
    got = fp.digest(fp.changed(spark.createDataFrame(rows, schema))).collect()
    assert len(got) == 6 and {r.near_edited for r in got if r.n_chars == 0} == {1.0}
    assert len({(r.fingerprint, r.edited_sha256) for r in got if r.doc_id == 5}) == 2
    one = fp.changed(spark.createDataFrame([(1, "abcde")], "doc_id long, text string")).first()
    assert one.edited == "abcab"


def test_no_code_point_is_left_out(spark):
    text = "one two\n\nthree " * 40 + "\n" * 9 + "日本" * 200 + "\nlast"
    kept = spark.createDataFrame([(text,)], "t string").select(F.array_join(F.flatten(F.transform(fp._all(F.col("t"), fp.SECTION), lambda s: F.flatten(F.transform(fp._all(s, fp.PARAGRAPH), lambda p: fp._all(p, fp.PIECE))))), "").alias("x")).first().x
    assert kept == text


@pytest.mark.parametrize("at", [0, 3, 17])
def test_edits_are_located(spark, at):
    lines = [f"line {n} holds its own words {n * 7} and a little more of them, so it has several pieces {n}\n" for n in range(20)]
    other = [*lines]
    other[at] = other[at].replace("words", "verbs")
    df = spark.createDataFrame([(1, "".join(lines)), (2, "".join(other))], "doc_id long, text string")
    a, b = (F.lit(r.fingerprint) for r in fp.fingerprints(df).orderBy("doc_id").collect())
    found = spark.range(1).select(fp.edits(a, b).alias("e"), fp.edits(a, a).alias("none"), fp.likeness(a, b).alias("like")).first()
    assert [(e.section, e.paragraph) for e in found.e] == [divmod(at, 8)] and len(found.e[0].leaves) == 1
    assert found.none == [] and 0.9 < found.like < 1


def test_no_python_on_the_path(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert "Python" not in fp.digest(fp.changed(docs))._jdf.queryExecution().executedPlan().toString()
