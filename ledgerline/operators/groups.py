"""Groups of flagged records: records that share transactions, with those transactions and the records next to them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import key_order
from ..sources.tables import settle
from .identity import RECORD

#: Stands between the parts of a record's name as a node; lower than any character of a name.
SEPARATOR = "\x1f"


def node() -> Column:
    """A record as one text, ordered as (database, table, pk)."""
    return F.concat_ws(SEPARATOR, "database", "table", "pk")


def components(links: DataFrame) -> DataFrame:
    """(case_id, node, root) of every node of links (case_id, a, b); root is the least node that links lead to.

    Alternating stars: each round first hangs the larger neighbours of a node on the least one near it, then each node
    and its smaller neighbours on the least of these. Edges never grow in number, a chain shrinks by a factor each round, and
    each round is one written table. A link of a node to itself is how a single node is named.
    """
    ends = settle(links.select("case_id", F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    single = ends.filter("u = v").select("case_id", F.col("u").alias("node"))
    edges, before = ends.filter("u <> v"), None
    while True:
        back = edges.select("case_id", F.col("v").alias("u"), F.col("u").alias("v"))
        near = edges.unionByName(back).groupBy("case_id", "u").agg(F.min("v").alias("m"))
        hung = back.join(near, ["case_id", "u"]).select("case_id", F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        least = hung.groupBy("case_id", "u").agg(F.min("v").alias("m"))
        pairs = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = settle(hung.join(least, ["case_id", "u"]).select("case_id", F.explode(pairs).alias("e")).select("case_id", "e.*").filter("u <> v").distinct())
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("case_id", "u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    joined = edges.select("case_id", F.col("u").alias("node"), F.col("v").alias("root"))
    roots = edges.select("case_id", F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    alone = single.join(joined.select("case_id", "node").unionByName(roots.select("case_id", "node")), ["case_id", "node"], "left_anti")
    return joined.unionByName(roots).unionByName(alone.select("case_id", "node", F.col("node").alias("root")))


def members(touched: DataFrame, flagged: DataFrame) -> DataFrame:
    """(RECORD, root): flagged records that some transaction touched, under the least record of their group.

    touched: distinct (RECORD, tx_id). The records of a transaction are linked as a star around the least of them, so a
    transaction of n records gives n links.
    """
    own = settle(touched.join(flagged.select(*RECORD).distinct(), RECORD, "left_semi").select(*RECORD, "tx_id", node().alias("a")))
    hubs = own.groupBy("case_id", "tx_id").agg(F.min("a").alias("b"))
    found = components(own.join(hubs, ["case_id", "tx_id"]).select("case_id", "a", "b"))
    return own.select(*RECORD, F.col("a").alias("node")).distinct().join(found, ["case_id", "node"]).drop("node")


@dataclass(frozen=True)
class Groups:
    """edges: (case_id, group_id, tx_id, record) of every record that a group's transactions touched. transactions: (case_id,
    group_id, tx_id). records: (RECORD, group_id, flagged, kind); a record next to two groups stands in both. names: (case_id,
    group_id, id, flagged, neighbours, transactions)."""

    edges: DataFrame
    transactions: DataFrame
    records: DataFrame
    names: DataFrame


def group_name(root: Column) -> Column:
    """database.table:pk of a node."""
    parts = F.split(root, SEPARATOR, 3)
    return F.concat(parts[0], F.lit("."), parts[1], F.lit(":"), parts[2])


def kind_of(results: Column) -> Column:
    """What a record is shown as, from the set of its fields' results; one without compared fields is context."""
    has = lambda name: F.array_contains(results, name)
    shown = F.when(has("Conflicting"), "conflicting").when(has("Unresolved"), "unresolved").when(has("Unsupported"), "unsupported").otherwise("agreeing")
    return F.when(F.coalesce(F.size(results), F.lit(0)) <= 0, "context").otherwise(shown)


def flagged_groups(record_events: DataFrame, flagged: DataFrame, field_verdicts: DataFrame) -> Groups:
    """Flagged records that share a transaction, directly or through others, with every transaction that touched one of
    them and every other record that those touched; no further.

    A group is named by its least record. names has the flagged records' names joined by + in order of table and key, the
    only text that grows with a group. Flagged records that no transaction touched are in no group.
    """
    touched = settle(record_events.filter("tx_id is not null").select(*RECORD, "tx_id").distinct())
    inside = settle(members(touched, flagged).withColumn("group_id", group_name(F.col("root"))).drop("root"))
    of_group = settle(touched.join(inside, RECORD).select("case_id", "group_id", "tx_id").distinct())
    edges = settle(of_group.join(touched, ["case_id", "tx_id"]).select("case_id", "group_id", "tx_id", *RECORD[1:]))
    kinds = field_verdicts.groupBy(*RECORD).agg(F.collect_set("result").alias("results")).select(*RECORD, kind_of(F.col("results")).alias("kind"))
    marked = inside.withColumn("flagged", F.lit(True))
    all_records = edges.select("case_id", "group_id", *RECORD[1:]).distinct()
    records = settle(all_records.join(marked, [*RECORD, "group_id"], "left").join(kinds, RECORD, "left").select(*RECORD, "group_id", F.coalesce("flagged", F.lit(False)).alias("flagged"), F.coalesce("kind", F.lit("context")).alias("kind")))
    place = F.struct("database", "table", key_order(F.col("pk")).alias("by"), F.concat("table", F.lit(":"), "pk").alias("name"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("flagged"), place))), lambda s: s["name"]), "+")
    names = records.groupBy("case_id", "group_id").agg(joined.alias("id"), F.count_if("flagged").alias("flagged"), F.count_if(~F.col("flagged")).alias("neighbours"))
    counts = of_group.groupBy("case_id", "group_id").agg(F.count("*").alias("transactions"))
    return Groups(edges, of_group, records, names.join(counts, ["case_id", "group_id"]))
