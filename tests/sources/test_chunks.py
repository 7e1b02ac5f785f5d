"""One log read in many chunks against the same log read whole."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerline.sources import text


def log(seed, n):
    rng = random.Random(seed)
    out, at = [], 4
    for t in range(n):
        at += rng.randint(10, 300)
        out.append(f"# at {at}")
        out.append(f"#2608{1 + t % 28:02d} {t % 24}:06:{t % 60:02d} server id 1  end_log_pos {at + 9}\tQuery\tthread_id={rng.randint(1, 5)}\texec_time=0")
        if rng.random() < 0.02 and t > n // 3:
            out.append(f"# original_commit_timestamp={1786820785000000 + t} (2026-08-15 21:06:25.000000 CEST)")
        if rng.random() < 0.3:
            out.append(f"SET @@SESSION.GTID_NEXT= 'aa-bb:{t}'/*!*/;")
        if rng.random() < 0.1:
            out.append(rng.choice(["use `shop`/*!*/;", "use `yard`/*!*/;", f"CREATE TABLE `t{t}` (id int)", f"CREATE TABLE `own`.`t{t}` (id int)"]))
        if rng.random() < 0.3:
            out.append("BEGIN")
        for _ in range(rng.randint(0, 3)):
            kind = rng.choice(["INSERT INTO", "UPDATE", "DELETE FROM"])
            out.append(f"### {kind} `shop`.`orders`")
            for part in {"INSERT INTO": ["SET"], "UPDATE": ["WHERE", "SET"], "DELETE FROM": ["WHERE"]}[kind]:
                out.append(f"### {part}")
                out += [f"###   @{c}={rng.choice(['1', 'NULL', repr('a=b'), repr('/* x */ y') + ' /* VARSTRING(20) meta=20 nullable=1 is_null=0 */', '2.50 /* DECIMAL(5,2) */'])}" for c in (1, 2)]
        if rng.random() < 0.3:
            out.append(rng.choice([f"# at {at + 5} Xid = {t}", "COMMIT/*!*/;", "ROLLBACK/*!*/;", "ROLLBACK /* added by */"]))
    return "\n".join(out) + "\n"


def everything(spark, path, limit):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(limit))
    lines = text.read_lines(spark, path)
    chunks = lines.select("file", "chunk").distinct().count()
    notes = text.annotated(lines).cache()
    events = text.change_log_events(notes)
    frames = (notes.drop("chunk"), events, text.transaction_markers(notes, events), text.table_creations(notes))
    out = [sorted((str(tuple(r)) for r in f.select(sorted(f.columns)).collect())) for f in frames]
    notes.unpersist()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    return chunks, out


@pytest.mark.parametrize("seed", [1, 2])
def test_many_chunks_equal_one(spark, tmp_path, seed):
    for name, n in (("log.000001", 900), ("log.000002", 40)):
        (tmp_path / name).write_text(log(seed, n))
    path = f"file://{tmp_path}"
    size = (tmp_path / "log.000001").stat().st_size
    few, whole = everything(spark, path, 1 << 27)
    many, parts = everything(spark, path, size // 70)
    assert few == 2 and many > 64 and all(whole) and parts == whole
    numbers = [r.line_no for r in text.read_lines(spark, path).filter("file = 'log.000001'").orderBy("line_no").collect()]
    assert numbers == list(range(1, len((tmp_path / "log.000001").read_text().splitlines()) + 1))


def test_cells(spark):
    lines = {
        "###   @1=5": (1, "5"), "###   @12='a=b' /* VARSTRING(9) meta=9 nullable=1 is_null=0 */": (12, "'a=b'"), "### @2='/* x */ y' /* STRING(9) */": (2, "'/* x */ y'"),
        "###   @3='it''s */'": (3, "'it''s */'"), "###   @4=": (4, ""), "### SET": None, "###   @x=1": None, "# @1=2": None, "### INSERT INTO `a`.`b`": None,
    }
    df = spark.createDataFrame([(k,) for k in lines], "line string").select("line", text.cell(F.col("line")).alias("c"))
    assert {r.line: (r.c.n, r.c.text) if r.c else None for r in df.collect()} == lines
