"""A change log with a matching snapshot, derived from orders by integer arithmetic: inserts, updates, key changes,
deletes, partial images, duplicates, rolled-back and unterminated transactions, and a snapshot that differs in places."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import value

DATABASE, TABLE, KEY = "shop", "orders", "o_orderkey"
COLUMNS = (("o_orderkey", "bigint", True), ("o_custkey", "int", False), ("o_orderstatus", "varchar(1)", False), ("price_cents", "bigint", False), ("o_orderpriority", "varchar(15)", False))
UUIDS = ("3e11fa47-71ca-11e1-9e33-c80aa9429562", "4f22ab58-71ca-11e1-9e33-c80aa9429562")


@dataclass(frozen=True)
class Case:
    """The input frames of an analysis, all keyed by case_id. runs, where they are recorded: which tool run decoded what."""

    events: DataFrame
    markers: DataFrame
    catalog: DataFrame
    snapshot: DataFrame
    log_files: DataFrame
    health: DataFrame
    extractions: DataFrame
    creations: DataFrame
    runs: DataFrame | None = None


def _image(key: Column, price: Column, partial: Column | None = None) -> Column:
    full = F.create_map(
        F.lit("o_orderkey"), value("int", key), F.lit("o_custkey"), value("int", F.col("custkey")), F.lit("o_orderstatus"), value("str", F.col("status")),
        F.lit("price_cents"), value("int", price), F.lit("o_orderpriority"), value("str", F.col("prio")),
    )
    if partial is None:
        return full
    return F.when(partial, F.create_map(F.lit("o_orderkey"), value("int", key), F.lit("price_cents"), value("int", price))).otherwise(full)


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(
        "o_orderkey as k", "if(o_custkey % 2 = 0, 'A', 'B') as case_id", "o_custkey as custkey", "o_orderstatus as status", "o_orderpriority as prio",
        "cast(round(o_totalprice * 100) as bigint) as cents",
    ).withColumn("price2", F.expr("cents + if(k % 2 = 0, 100 * (k % 50), 0)"))


def _table(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """A few rows as a relation whose size Spark knows when it plans, so that joins with it need no shuffle of the other side."""
    said = lambda x: str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else f"'{x}'"
    return spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(map(said, r)) + ')' for r in rows)} AS t({names})")


def derive(spark: SparkSession, sf_dir: str) -> Case:
    o = base(spark, sf_dir)
    none = F.lit(None).cast("map<string,struct<kind:string,text:string>>")
    k = F.col("k")

    def event(when: str, kind: str, file: str, position: str, row: str, t: str, before: Column, after: Column, copy: int = 0) -> DataFrame:
        placed = o.filter(when).withColumns({"file": F.expr(file).cast("int"), "log_position": F.expr(position).cast("long"), "row_index": F.expr(row).cast("int"), "t": F.expr(t).cast("long")})
        h = F.col("file") * 1000 + F.col("t")
        return placed.select(
            "case_id", F.concat(F.lit("log.00000"), "file").alias("source_file"), "log_position", "row_index",
            (F.col("file") * 10**12 + F.col("log_position") * 100 + F.col("row_index") * 10 + copy).cast("long").alias("ingest_ord"),
            F.lit(kind).alias("event_type"), F.lit(DATABASE).alias("database"), F.lit(TABLE).alias("table"), before.alias("before"), after.alias("after"),
            (F.lit("2026-08-15 19:06:25").cast("timestamp") + F.make_dt_interval(secs=h)).alias("ts"),
            F.when(h % 46 != 9, 13 + h % 5).cast("long").alias("thread_id"), F.col("file").alias("file_no"), "t",
        )

    update = ("k % 2 = 0", "UPDATE", "4", "1000 + 100 * (k div 4)", "(k % 4) div 2", "(k div 4) div 5", _image(k, F.col("cents")), _image(k, F.col("price2"), k % 5 == 0))
    all_events = (
        event("k % 10 <> 0", "INSERT", "1 + k % 3", "1000 + 100 * (k div 12)", "(k % 12) div 3", "(k div 12) div 5", none, _image(k, F.col("cents")))
        .unionByName(event(*update))
        .unionByName(event("k % 500 = 0", *update[1:], copy=1))
        .unionByName(event("k % 41 = 0", "UPDATE", "5", "1000 + 100 * k", "0", "k div 50", _image(k, F.col("price2")), _image(k + 10_000_000, F.col("price2"))))
        .unionByName(event("k % 410 = 0", "UPDATE", "5", "1050 + 100 * k", "0", "k div 50", _image(k, F.col("price2")), _image(k + 11_000_000, F.col("price2"))))
        .unionByName(event("k % 123 = 0", "UPDATE", "5", "1060 + 100 * k", "0", "k div 50", _image(k + 10_000_000, F.col("price2")), _image(k, F.col("price2"))))
        .unionByName(event("k % 13 = 0", "DELETE", "6", "1000 + 100 * k", "0", "k div 50", _image(k, F.expr("price2 + if(k % 91 = 0, 500, 0)")), none))
    )
    h = F.col("file_no") * 1000 + F.col("t")
    grouped = all_events.groupBy("case_id", "source_file", "file_no", "t").agg((F.min("log_position") - 50).alias("start_position"), (F.max("log_position") + 50).alias("end_position"), F.array_sort(F.collect_set("log_position")).alias("positions"))
    status = F.when(h % 11 == 3, "rolled_back").when((F.col("case_id") == "B") & (h % 17 == 5), "incomplete").otherwise("committed")
    uuid = F.when((F.col("case_id") == "B") & (F.col("file_no") == 6), UUIDS[1]).otherwise(UUIDS[0])
    markers = grouped.filter(~((F.col("file_no") == 1) & (F.col("t") == 0)) & (h % 19 != 7)).select(
        "case_id", "source_file", "start_position", "end_position", status.alias("status"),
        F.when(h % 23 == 9, F.expr("cast(array() as array<bigint>)")).otherwise(F.col("positions")).alias("event_positions"),
        F.concat(uuid, F.lit(":"), (F.col("file_no") * 100000 + F.col("t")).cast("string")).alias("gtid"), F.when(status == "committed", h).cast("long").alias("xid"), (13 + h % 5).cast("long").alias("thread_id"),
    )
    cases = _table(spark, [("A",), ("B",)], "case_id")
    catalog = _table(spark, [(case, DATABASE, TABLE, c, n, t, pk) for case in "AB" for n, (c, t, pk) in enumerate(COLUMNS, 1)], "case_id, database, table, column, position, data_type, is_primary_key")
    snap = o.filter("k % 31 <> 0 and not (k % 13 = 0 and k % 3 <> 0)").select("*", F.explode(F.expr("filter(array(0, if(k % 43 = 0, 1, null), if(k % 37 = 0, 2, null), if(k % 53 = 0, 3, null)), x -> x is not null)")).alias("copy"))
    # plain row, second live row, deleted remnant, row under a key that the log never saw
    price = F.col("price2") + F.when(k % 29 == 0, 1).otherwise(0)
    shown = F.when(F.col("copy") == 3, k + 20_000_000).otherwise(k)
    image = _image(shown, price)
    broken = F.map_concat(F.map_filter(image, lambda c, _: c != "o_orderstatus"), F.create_map(F.lit("o_orderstatus"), value("undecodable", "bad length")))
    snapshot = snap.select(
        "case_id", (k * 10 + F.col("copy")).cast("long").alias("snapshot_ord"), F.lit(DATABASE).alias("database"), F.lit(TABLE).alias("table"),
        F.when(k % 47 == 0, broken).otherwise(image).alias("values"), ((F.col("copy") == 2) | ((k % 13 == 0) & (F.col("copy") == 0))).alias("is_deleted"),
    )
    log_files = _table(spark, [(c, n, f"/var/log/log.00000{n}", n <= 6) for c in "AB" for n in range(1, 7 + (c == "B"))], "case_id, seq, file, present")
    tables = cases.withColumns({"database": F.lit(DATABASE), "table": F.lit(TABLE)})
    health = tables.withColumns({"status": F.lit("valid"), "total_pages": F.lit(7).cast("long"), "damaged_pages": F.lit(0).cast("long")})
    return Case(all_events.drop("file_no", "t"), markers, catalog, snapshot, log_files, health, tables, tables.withColumns({"source_file": F.lit("log.000001"), "log_position": F.lit(4).cast("long")}))


#: The same derivation in SQL, with images as plain columns. DuckDB and the tests start from it.
SQL = """
o AS (SELECT o_orderkey AS k, CASE WHEN o_custkey % 2 = 0 THEN 'A' ELSE 'B' END AS case_id, o_custkey AS custkey, o_orderstatus AS status, o_orderpriority AS prio, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
o2 AS (SELECT *, cents + CASE WHEN k % 2 = 0 THEN 100 * (k % 50) ELSE 0 END AS price2 FROM o),
ev0 AS (
  SELECT case_id, 1 + k % 3 AS f, 1000 + 100 * (k // 12) AS pos, (k % 12) // 3 AS ri, (k // 12) // 5 AS t, 0 AS cp, 'INSERT' AS ty, CAST(NULL AS BIGINT) AS bk, k AS ak, CAST(NULL AS BIGINT) AS bp, cents AS ap, 0 AS part, custkey, status, prio, k FROM o2 WHERE k % 10 <> 0
  UNION ALL SELECT case_id, 4, 1000 + 100 * (k // 4), (k % 4) // 2, (k // 4) // 5, 0, 'UPDATE', k, k, cents, price2, CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END, custkey, status, prio, k FROM o2 WHERE k % 2 = 0
  UNION ALL SELECT case_id, 4, 1000 + 100 * (k // 4), (k % 4) // 2, (k // 4) // 5, 1, 'UPDATE', k, k, cents, price2, CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END, custkey, status, prio, k FROM o2 WHERE k % 500 = 0
  UNION ALL SELECT case_id, 5, 1000 + 100 * k, 0, k // 50, 0, 'UPDATE', k, k + 10000000, price2, price2, 0, custkey, status, prio, k FROM o2 WHERE k % 41 = 0
  UNION ALL SELECT case_id, 5, 1050 + 100 * k, 0, k // 50, 0, 'UPDATE', k, k + 11000000, price2, price2, 0, custkey, status, prio, k FROM o2 WHERE k % 410 = 0
  UNION ALL SELECT case_id, 5, 1060 + 100 * k, 0, k // 50, 0, 'UPDATE', k + 10000000, k, price2, price2, 0, custkey, status, prio, k FROM o2 WHERE k % 123 = 0
  UNION ALL SELECT case_id, 6, 1000 + 100 * k, 0, k // 50, 0, 'DELETE', k, NULL, price2 + CASE WHEN k % 91 = 0 THEN 500 ELSE 0 END, NULL, 0, custkey, status, prio, k FROM o2 WHERE k % 13 = 0),
ev1 AS (SELECT *, f * 1000 + t AS h FROM ev0),
ev AS (SELECT *, CASE WHEN h % 46 <> 9 THEN 13 + h % 5 END AS th FROM ev1 WHERE cp = 0),
mk0 AS (SELECT case_id, f, t, h, min(pos) - 50 AS s, max(pos) + 50 AS e FROM ev GROUP BY ALL),
mk AS (SELECT *, CASE WHEN h % 11 = 3 THEN 'rolled_back' WHEN case_id = 'B' AND h % 17 = 5 THEN 'incomplete' ELSE 'committed' END AS st, h % 23 = 9 AS ses,
  CASE WHEN case_id = 'B' AND f = 6 THEN '4f22ab58-71ca-11e1-9e33-c80aa9429562' ELSE '3e11fa47-71ca-11e1-9e33-c80aa9429562' END AS uuid, 13 + h % 5 AS th FROM mk0 WHERE NOT (f = 1 AND t = 0) AND h % 19 <> 7),
sn0 AS (SELECT *, unnest([0, 1, 2, 3]) AS cp FROM o2 WHERE k % 31 <> 0 AND NOT (k % 13 = 0 AND k % 3 <> 0)),
sn AS (SELECT case_id, k * 10 + cp AS so, CASE WHEN cp = 3 THEN k + 20000000 ELSE k END AS sk, custkey, status, prio, price2 + CASE WHEN k % 29 = 0 THEN 1 ELSE 0 END AS price, k % 47 = 0 AS broken, cp = 2 OR (k % 13 = 0 AND cp = 0) AS del FROM sn0
  WHERE cp = 0 OR (cp = 1 AND k % 43 = 0) OR (cp = 2 AND k % 37 = 0) OR (cp = 3 AND k % 53 = 0))
"""
