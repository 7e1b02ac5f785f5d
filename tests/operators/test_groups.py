import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import groups

RECORD = "case_id string, database string, table string, pk string"


def brute(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for case, a, b in links:
        x, y = find((case, a)), find((case, b))
        parent[max(x, y)] = min(x, y)
    return sorted((c, n, find((c, n))[1]) for c, n in parent)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    name = lambda: f"{rng.randint(0, 300):04d}"
    links = [(rng.choice("AB"), name(), name()) for _ in range(200)] + [("C", "1", "1"), ("C", "2", "1")] + [("D", "0", f"{n}") for n in range(100)]
    got = groups.components(spark.createDataFrame(links, "case_id string, a string, b string"))
    assert sorted(map(tuple, got.collect())) == brute(links)


def test_a_long_chain_needs_few_rounds(spark, monkeypatch):
    rounds = []
    settle = groups.settle
    monkeypatch.setattr(groups, "settle", lambda df: rounds.append(1) or settle(df))
    links = spark.range(4095).select(F.lit("A").alias("case_id"), F.format_string("%06d", "id").alias("a"), F.format_string("%06d", F.col("id") + 1).alias("b"))
    got = groups.components(links)
    assert got.count() == 4096 and got.select("root").distinct().count() == 1 and len(rounds) <= 30


def test_groups_with_neighbours(spark):
    rows = [("A", "shop", "o", pk, tx) for pk, tx in [("10", "t1"), ("9", "t1"), ("9", "t2"), ("7", "t2"), ("5", "t3"), ("7", "t3"), ("8", "t4"), ("3", None)]]
    events = spark.createDataFrame([*rows, ("B", "shop", "o", "9", "t1")], RECORD + ", tx_id string")
    flagged = spark.createDataFrame([("A", "shop", "o", pk) for pk in ("10", "9", "8", "3", "5")], RECORD)
    fields = spark.createDataFrame([("A", "shop", "o", "10", "Conflicting"), ("A", "shop", "o", "10", "Exact"), ("A", "shop", "o", "9", "Unresolved"), ("A", "shop", "o", "7", "Exact"), ("A", "shop", "o", "8", "Unresolved"), ("A", "shop", "o", "5", "Conflicting")], RECORD + ", result string")
    g = groups.flagged_groups(events, flagged, fields)
    assert sorted((r.group_id, r.tx_id) for r in g.transactions.collect()) == [("shop.o:10", "t1"), ("shop.o:10", "t2"), ("shop.o:5", "t3"), ("shop.o:8", "t4")]
    assert sorted((r.group_id, r.pk, r.flagged, r.kind) for r in g.records.collect()) == [
        ("shop.o:10", "10", True, "conflicting"), ("shop.o:10", "7", False, "agreeing"), ("shop.o:10", "9", True, "unresolved"),
        ("shop.o:5", "5", True, "conflicting"), ("shop.o:5", "7", False, "agreeing"), ("shop.o:8", "8", True, "unresolved"),
    ]
    assert sorted((r.id, r.flagged, r.neighbours, r.transactions) for r in g.names.collect()) == [("o:5", 1, 1, 1), ("o:8", 1, 0, 1), ("o:9+o:10", 2, 1, 2)]


def test_nothing_flagged(spark):
    none = spark.createDataFrame([], RECORD + ", tx_id string, result string")
    g = groups.flagged_groups(none, none, none)
    assert g.records.isEmpty() and g.names.isEmpty()


def test_a_record_without_compared_fields_is_context(spark):
    df = spark.createDataFrame([([],), (None,), (["Unsupported"],)], "r array<string>").select(groups.kind_of(F.col("r")).alias("k"))
    assert [r.k for r in df.collect()] == ["context", "context", "unsupported"]
