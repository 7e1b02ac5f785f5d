"""Evidence written as text, in the forms that sources.text reads: decoded change logs and snapshot dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE_KEY = ["case_id", "database", "table"]
#: The server's local time is written, so many hours ahead of UTC.
OFFSET_HOURS = 2


def _quoted(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''")), F.lit("'"))


def written(v: Column) -> Column:
    """A VALUE as a SQL literal; an undecodable one as bytes, which read back as undecodable."""
    return F.when(v["kind"] == "null", F.lit("NULL")).when(v["kind"].isin("int", "dec"), v["text"]).when(v["kind"] == "undecodable", F.lit("0xFF")).otherwise(_quoted(v["text"]))


def _header(end: Column, what: Column) -> Column:
    local = F.date_format(F.col("ts") + F.make_dt_interval(hours=F.lit(OFFSET_HOURS)), "yyMMdd HH:mm:ss")
    return F.concat(F.lit("#"), local, F.lit(" server id 1  end_log_pos "), end.cast("string"), F.lit("\t"), what)


def _at(position: Column) -> Column:
    return F.concat(F.lit("# at "), position.cast("string"))


def change_log(events: DataFrame, markers: DataFrame, catalog: DataFrame) -> DataFrame:
    """(case_id, source_file, place, line_no, line): the decoded text of a log. place orders blocks of lines within a file.

    events: as an analysis reads them, with ts. markers: (case_id, source_file, start_position, end_position, status, gtid, xid,
    thread_id, ts), no event outside of its marker's bounds. Columns are numbered by the catalog.
    """
    numbers = catalog.groupBy(*TABLE_KEY).agg(F.map_from_entries(F.collect_list(F.struct("column", "position"))).alias("at_"))
    rows = events.join(numbers, TABLE_KEY)
    verbs = F.create_map(*[F.lit(x) for x in ("INSERT", "INSERT INTO", "UPDATE", "UPDATE", "DELETE", "DELETE FROM")])
    cells = lambda c: F.transform(F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(F.col("at_")[e["key"]].alias("n"), written(e["value"]).alias("v")))), lambda x: F.concat(F.lit("###   @"), x["n"].cast("string"), F.lit("="), x["v"], F.lit(" /* type */")))
    image = lambda c, name: F.when(F.col(c).isNotNull(), F.concat(F.array(F.lit(f"### {name}")), cells(c))).otherwise(F.expr("cast(array() as array<string>)"))
    target = F.concat(F.lit("### "), verbs[F.col("event_type")], F.lit(" `"), "database", F.lit("`.`"), "table", F.lit("`"))
    body = F.concat(F.array(_at(F.col("log_position")), _header(F.col("log_position") + 5, F.concat(F.initcap("event_type"), F.lit("_rows: table id 87"))), target), image("before", "WHERE"), image("after", "SET"))
    place = lambda position, phase, row: F.struct(position.alias("position"), F.lit(phase).alias("phase"), row.cast("int").alias("row"))
    blocks = rows.select("case_id", "source_file", place(F.col("log_position"), 2, F.col("row_index")).alias("place"), body.alias("lines"))
    start, end = F.col("start_position"), F.col("end_position")
    began = F.array(_at(start), _header(start + 1, F.concat(F.lit("Query\tthread_id="), F.col("thread_id").cast("string"), F.lit("\texec_time=0"))), F.concat(F.lit("SET @@SESSION.GTID_NEXT= '"), "gtid", F.lit("'/*!*/;")), F.lit("BEGIN"), F.lit("/*!*/;"))
    closing = F.when(F.col("status") == "committed", F.array(_at(end - 1), _header(end, F.concat(F.lit("Xid = "), F.coalesce("xid", F.lit(0)).cast("string"))), F.lit("COMMIT/*!*/;"))).when(F.col("status") == "rolled_back", F.array(_at(end - 1), _header(end, F.lit("Query")), F.lit("ROLLBACK/*!*/;"))).otherwise(F.array(F.lit("# end of transaction not found")))
    marked = markers.select("case_id", "source_file", place(start, 1, F.lit(0)).alias("place"), began.alias("lines")).unionByName(markers.select("case_id", "source_file", place(end - 1, 3, F.lit(0)).alias("place"), closing.alias("lines")))
    first = events.groupBy("case_id", "source_file").agg(F.min("ts").alias("ts"))
    told = F.concat(F.lit("# original_commit_timestamp="), F.unix_micros("ts").cast("string"), F.lit(" ("), F.date_format(F.col("ts") + F.make_dt_interval(hours=F.lit(OFFSET_HOURS)), "yyyy-MM-dd HH:mm:ss"), F.lit(".000000 CEST)"))
    head = first.select("case_id", "source_file", place(F.lit(4).cast("long"), 0, F.lit(0)).alias("place"), F.array(_at(F.lit(4)), told).alias("lines"))
    return blocks.unionByName(marked).unionByName(head).select("case_id", "source_file", "place", F.posexplode("lines").alias("line_no", "line"))


def write_pieces(lines: DataFrame, path: str, order: list[str]) -> None:
    """Write (log, line, order columns) as text: a folder for each log, its pieces in order, ranges of all logs being written at once."""
    lines.repartitionByRange("log", *order).sortWithinPartitions("log", *order).select("log", "line").write.partitionBy("log").text(path)


def snapshot_dump(snapshot: DataFrame) -> DataFrame:
    """(case_id, snapshot_ord, line): snapshot rows as INSERT statements; live and deleted rows are told apart by the reader."""
    entries = F.map_entries("values")
    names = F.array_join(F.transform(entries, lambda e: F.concat(F.lit("`"), e["key"], F.lit("`"))), ", ")
    held = F.array_join(F.transform(entries, lambda e: written(e["value"])), ", ")
    return snapshot.select("case_id", "snapshot_ord", "is_deleted", F.concat(F.lit("INSERT INTO `"), "database", F.lit("`.`"), "table", F.lit("` ("), names, F.lit(") VALUES ("), held, F.lit(");")).alias("line"))
