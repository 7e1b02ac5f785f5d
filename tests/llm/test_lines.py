import hashlib
import random

from ledgerline.llm import lines
from ledgerline.llm.lines import LEAST_WORDS


def brute_force(texts: list[str | None], least_words: int = LEAST_WORDS) -> list[tuple[int, str]]:
    """What dedup does, for small lists in order of doc_id: (lines deleted, SHA-256 of what is left)."""
    docs = [[] if t is None else t.split("\n") for t in texts]
    seen: dict[tuple, tuple[int, int]] = {}
    for d, lines in enumerate(docs):
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                seen.setdefault(tuple(lines[a:b]), (d, a))
    out = []
    for d, lines in enumerate(docs):
        stay = [True] * len(lines)
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if sum(len(x.split()) for x in lines[a:b]) >= least_words and seen[tuple(lines[a:b])] < (d, a):
                    stay[a:b] = [False] * (b - a)
        left = "\n".join(x for x, s in zip(lines, stay, strict=True) if s)
        out.append((stay.count(False), hashlib.sha256(left.encode()).hexdigest()))
    return out


def check(spark, texts, ids=None):
    rows = [(i, t, i) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rank int").repartition(1).withColumn("gone", lines.F.lit("x"))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_deleted, r.text_sha256) for r in lines.digest(lines.dedup(df)).collect())
    assert got == sorted((-1 if i is None else i, *w) for i, w in zip(ids or range(len(texts)), brute_force(texts), strict=True))
    return sum(g[1] for g in got)


def test_random_texts(spark):
    rng = random.Random(5)
    pool = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 12]))) for _ in range(14)]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 14))) for _ in range(40)]
    assert check(spark, texts) > 50


def test_odd_texts(spark):
    long = "one two three four five six seven eight nine ten eleven"
    texts = [None, "", long, long, "a\n" * 60, "\n\n\n", long + "\n" + long, "x " * 50_000, "x " * 50_000, "a b c\nd e f\ng h i\nj", "z\na b c\nd e f\ng h i\nj\ny"]
    assert check(spark, texts) > 5


def test_null_ids_and_empty(spark):
    long = "one two three four five six seven eight nine ten eleven"
    assert check(spark, [long, long], [None, 4]) == 1
    assert lines.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ids_outlive_other_file_splits(spark, tmp_path):
    rng = random.Random(8)
    pool = [" ".join(f"w{rng.randrange(900)}" for _ in range(12)) for _ in range(60)]
    texts = ["\n".join(rng.choice(pool) for _ in range(6)) for _ in range(60)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(12).write.parquet(path)
    names = {"spark.sql.files.openCostInBytes": "128m", "spark.sql.files.minPartitionNum": "1"}
    out = lines.digest(lines.dedup(spark.read.parquet(path)))
    try:
        # one file a split instead of several, as when executors come between two scans
        for name, value in names.items():
            spark.conf.set(name, value)
        got = sorted((r.doc_id, r.n_deleted, r.text_sha256) for r in out.collect())
    finally:
        for name in names:
            spark.conf.unset(name)
    assert got == [(i, *w) for i, w in enumerate(brute_force(texts))]
