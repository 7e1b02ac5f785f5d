"""Bulk readers of text evidence: decoded change logs, snapshot dumps, dictionary JSON, page reports, log lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.values import basename, literal, value

#: One value of a quoted list: either quote character, doubled or escaped, or anything up to a comma.
LIST_ITEM = r"""\s*('(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|[^,]+?)\s*(?:,|$)"""


def read_lines(spark: SparkSession, path: str, in_pieces: bool = False) -> DataFrame:
    """(file, chunk, line_no, line): lines of text files. A chunk is a split of a file, so one file of any size is read by many tasks.

    Lines are numbered within their chunk; how many lines stand before a chunk is the sum over the chunks before it.
    in_pieces: each folder holds one log in pieces, files in order of their names, and gives the log its name.
    """
    name = F.substring_index(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2), "=", -1) if in_pieces else F.col("_metadata.file_name")
    chunk = F.concat_ws("@", F.when(F.lit(in_pieces), F.col("_metadata.file_name")), F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0"))
    rows = spark.read.text(f"{path}/*" if in_pieces else path).select(F.col("value").alias("line"), name.alias("file"), chunk.alias("chunk"), F.monotonically_increasing_id().alias("id_"))
    earlier = Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    ahead = rows.groupBy("file", "chunk").agg(F.count("*").alias("n_")).select("file", "chunk", F.coalesce(F.sum("n_").over(earlier), F.lit(0)).alias("ahead_"))
    placed = rows.withColumn("at_", F.row_number().over(Window.partitionBy("file", "chunk").orderBy("id_")))
    return placed.join(ahead, ["file", "chunk"]).select("file", "chunk", (F.col("at_") + F.col("ahead_")).alias("line_no"), "line")


def carried(lines: DataFrame, last: dict[str, Column], first: dict[str, Column], sums: dict[str, Column]) -> DataFrame:
    """lines with what holds where each stands in its file: the last or the first value seen so far, or the sum so far.

    A prefix scan in two levels. Each chunk is summed up by an aggregate that Spark combines before it shuffles; the
    summaries, one row for each chunk, are scanned in order of the file; each chunk starts from what the scan brings it and
    goes through its own lines alone.
    """
    seen = lambda c: F.when(c.isNotNull(), F.col("line_no"))
    told = lines.groupBy("file", "chunk").agg(
        *[F.max_by(c, seen(c)).alias(f"{n}_in") for n, c in last.items()], *[F.min_by(c, seen(c)).alias(f"{n}_in") for n, c in first.items()], *[F.sum(c).alias(f"{n}_in") for n, c in sums.items()]
    )
    earlier = Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    brought = told.select(
        "file", "chunk",
        *[F.last(f"{n}_in", True).over(earlier).alias(f"{n}_in") for n in last], *[F.first(f"{n}_in", True).over(earlier).alias(f"{n}_in") for n in first], *[F.coalesce(F.sum(f"{n}_in").over(earlier), F.lit(0)).alias(f"{n}_in") for n in sums],
    )
    running = Window.partitionBy("file", "chunk").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    here = lines.select("*", *[F.last(c, True).over(running).alias(f"{n}_at") for n, c in last.items()], *[F.first(c, True).over(running).alias(f"{n}_at") for n, c in first.items()], *[F.sum(c).over(running).alias(f"{n}_at") for n, c in sums.items()])
    both = here.join(brought, ["file", "chunk"])
    return both.select(
        *lines.columns, *[F.coalesce(f"{n}_at", f"{n}_in").alias(n) for n in last], *[F.coalesce(f"{n}_in", f"{n}_at").alias(n) for n in first], *[(F.col(f"{n}_in") + F.col(f"{n}_at")).alias(n) for n in sums]
    )


def _match(pattern: str, group: int = 1) -> Column:
    return F.when(F.col("line").rlike(pattern), F.regexp_extract("line", pattern, group))


def annotated(lines: DataFrame) -> DataFrame:
    """Every line with what holds where it stands: position, time, GTID, thread, default database, transaction and row islands.

    Times are local to the server; its offset is known from the first commit comment of the file on, and lines before that
    are read as UTC.
    """
    row_start = F.col("line").rlike(r"^### (INSERT INTO|UPDATE|DELETE FROM) ")
    utc = _match(r"^# original_commit_timestamp=(\d+)")
    shown = F.when(utc.isNotNull(), F.regexp_extract("line", r"\((\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)", 1))
    out = carried(
        lines,
        {
            "raw_ts": _match(r"^#(\d{6} +\d{1,2}:\d{2}:\d{2}) server id"),
            "log_position": _match(r"^# at (\d+)").cast("long"),
            "end_position": _match(r"end_log_pos (\d+)").cast("long"),
            "gtid": _match(r"GTID_NEXT= *'([^']+)'"),
            "thread_id": _match(r"thread_id=(\d+)").cast("long"),
            # a row begins outside of both of its images
            "section": F.when(row_start, F.lit("")).otherwise(_match(r"^### (WHERE|SET)\s*$")),
            "used": _match(r"^use `([^`]+)`"),
        },
        {"offset": F.when(utc.isNotNull(), F.unix_timestamp(F.to_timestamp(shown)) - F.floor(utc.cast("long") / 1_000_000))},
        {"row_island": row_start.cast("int"), "tx_island": F.col("line").rlike(r"^BEGIN\b").cast("int")},
    )
    local = F.to_timestamp(F.concat(F.lit("20"), F.regexp_replace("raw_ts", r" +", " ")), "yyyyMMdd H:mm:ss")
    ts = F.timestamp_seconds(F.unix_timestamp(local) - F.coalesce("offset", F.lit(0)))
    return out.withColumns({"ts": ts, "is_row": row_start, "section": F.when(F.col("section") != "", F.col("section"))}).drop("offset")


def cell(line: Column) -> Column:
    """struct(n, text) of a line `### @n=value /* type */` of a row image, null for any other line: what stands behind the
    first = without the comment that ends the line."""
    body = F.trim(F.substring(line, 4, 1 << 30))
    name = F.substring_index(body, "=", 1)
    said = F.trim(F.substr(body, F.length(name) + 2))
    comment = F.length(F.substring_index(said, "/*", -1)) + 2
    value_ = F.when(F.endswith(said, F.lit("*/")) & F.contains(said, F.lit("/*")), F.trim(F.substr(said, F.lit(1), F.length(said) - comment))).otherwise(said)
    n = F.substring(name, 2, 1 << 30).try_cast("int")
    return F.when(F.startswith(line, F.lit("###")) & F.startswith(body, F.lit("@")) & F.contains(body, F.lit("=")) & n.isNotNull(), F.struct(n.alias("n"), value_.alias("text")))


def change_log_events(notes: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """One row per row image: event_type, database, table, before, after, position, row_index. Columns are named from
    the catalog (database, table, column, position) where it has them, else @n."""
    kind = {"INSERT INTO": "INSERT", "UPDATE": "UPDATE", "DELETE FROM": "DELETE"}
    verb = _match(r"^### (INSERT INTO|UPDATE|DELETE FROM) ")
    starts = notes.filter("is_row").select(
        F.col("file").alias("source_file"), "row_island", "log_position", "ts", "raw_ts", "gtid", "thread_id", "tx_island", "line_no",
        F.element_at(F.create_map(*[F.lit(x) for kv in kind.items() for x in kv]), verb).alias("event_type"), _match(r"`([^`]+)`\.`([^`]+)`", 1).alias("database"), _match(r"`([^`]+)`\.`([^`]+)`", 2).alias("table"),
    )
    indexed = starts.withColumn("row_index", (F.row_number().over(Window.partitionBy("source_file", "log_position").orderBy("line_no")) - 1).cast("int"))
    cells = notes.withColumn("cell", cell(F.col("line"))).filter("cell is not null").select(F.col("file").alias("source_file"), "row_island", "section", "cell.n", literal(F.col("cell.text"), "log").alias("v"))
    named = cells.join(indexed.select("source_file", "row_island", "database", "table"), ["source_file", "row_island"])
    if catalog is not None:
        named = named.join(catalog.select("database", "table", F.col("position").alias("n"), F.col("column")), ["database", "table", "n"], "left")
    else:
        named = named.withColumn("column", F.lit(None).cast("string"))
    column = F.coalesce("column", F.concat(F.lit("@"), F.col("n").cast("string")))
    image = lambda s: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("section") == s, F.struct(column.alias("key"), F.col("v").alias("value"))))))
    images = named.groupBy("source_file", "row_island").agg(image("WHERE").alias("where_"), image("SET").alias("set_"))
    none = lambda c: F.when(F.size(c) > 0, F.col(c))
    return indexed.join(images, ["source_file", "row_island"], "left").select("source_file", "log_position", "row_index", "event_type", "database", "table", none("where_").alias("before"), none("set_").alias("after"), "ts", "raw_ts", "gtid", "thread_id", "tx_island")


def transaction_markers(notes: DataFrame, events: DataFrame) -> DataFrame:
    """One row per BEGIN: positions, status by the first terminator after it (incomplete at end of file), xid."""
    ends = F.when(F.col("line").rlike(r"^(COMMIT\b|.*\bXid = \d+)"), "committed").when(F.col("line").rlike(r"^ROLLBACK\b") & ~F.col("line").rlike("added by"), "rolled_back")
    spans = notes.filter("tx_island > 0").withColumn("ends", ends)
    last = F.min_by(F.when(F.col("ends").isNotNull(), F.struct("ends", "end_position")), F.when(F.col("ends").isNotNull(), F.col("line_no")))
    marked = spans.groupBy(F.col("file").alias("source_file"), "tx_island").agg(F.min("log_position").alias("start_position"), last.alias("end_"), F.max("end_position").alias("last_position"), F.min_by("gtid", F.when(F.col("gtid").isNotNull(), F.col("line_no"))).alias("gtid"), F.min_by("thread_id", F.when(F.col("thread_id").isNotNull(), F.col("line_no"))).alias("thread_id"), F.max(_match(r"Xid = (\d+)").cast("long")).alias("xid"))
    listed = events.filter("tx_island > 0").groupBy("source_file", "tx_island").agg(F.array_sort(F.collect_set("log_position")).alias("event_positions"))
    positions = F.coalesce("event_positions", F.expr("cast(array() as array<bigint>)"))
    return marked.join(listed, ["source_file", "tx_island"], "left").select("source_file", "start_position", F.coalesce("end_.end_position", "last_position").alias("end_position"), F.coalesce("end_.ends", F.lit("incomplete")).alias("status"), positions.alias("event_positions"), "gtid", "xid", "thread_id")


def table_creations(notes: DataFrame) -> DataFrame:
    """CREATE TABLE statements seen (not IF NOT EXISTS), with the default database in force."""
    pattern = r"(?i)^CREATE TABLE (?!IF NOT EXISTS)(?:`?([\w$]+)`?\.)?`?([\w$]+)`?"
    seen = notes.filter(F.col("line").rlike(pattern))
    own = F.regexp_extract("line", pattern, 1)
    return seen.select(F.when(own != "", own).otherwise(F.col("used")).alias("database"), F.regexp_extract("line", pattern, 2).alias("table"), F.col("file").alias("source_file"), "log_position")


def list_items(text: Column) -> Column:
    """Values of a quoted, comma-separated list, as written."""
    return F.transform(F.regexp_extract_all(text, F.lit(LIST_ITEM), F.lit(1)), lambda x: F.trim(x))


def snapshot_inserts(lines: DataFrame, deleted: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, dropped): INSERT statements as snapshot rows; a row whose values do not match its columns is dropped."""
    pattern = r"(?i)^INSERT INTO `([^`]+)`\.`([^`]+)` ?\(([^)]*)\) VALUES ?\((.*)\);?\s*$"
    found = lines.filter(F.col("line").rlike(pattern)).select(
        "file", "line_no", F.regexp_extract("line", pattern, 1).alias("database"), F.regexp_extract("line", pattern, 2).alias("table"),
        F.transform(F.split(F.regexp_extract("line", pattern, 3), ","), lambda c: F.regexp_replace(F.trim(c), "`", "")).alias("names"), list_items(F.regexp_extract("line", pattern, 4)).alias("items"),
    )
    fits = F.size("names") == F.size("items")
    values = F.map_from_arrays("names", F.transform("items", lambda x: literal(x, "snapshot")))
    rows = found.filter(fits).select("file", F.col("line_no").cast("long").alias("snapshot_ord"), "database", "table", values.alias("values"), F.lit(deleted).alias("is_deleted"))
    return rows, found.filter(~fits).select("file", "line_no", "database", "table")


DICTIONARY = "array<struct<object:struct<dd_object:struct<name:string,schema_ref:string,columns:array<struct<name:string,ordinal_position:int,column_type_utf8:string,is_nullable:boolean,hidden:int>>,indexes:array<struct<type:int,elements:array<struct<column_opx:int,hidden:boolean>>>>>>>>"


def catalog_json(spark: SparkSession, path: str) -> DataFrame:
    """Catalog rows of dictionary JSON files: visible columns by ordinal, renumbered from 1, with the primary key marked."""
    text = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", DICTIONARY)).alias("o")).select("o.object.dd_object.*").filter("columns is not null")
    flat = text.select(F.col("schema_ref").alias("database"), F.col("name").alias("table"), F.posexplode("columns").alias("raw", "c"), "indexes")
    in_key = F.exists("indexes", lambda i: (i["type"] == 1) & F.exists(i["elements"], lambda e: ~e["hidden"] & (e["column_opx"] == F.col("raw"))))
    by_ordinal = Window.partitionBy("database", "table").orderBy("c.ordinal_position")
    return flat.withColumn("pk", in_key).filter("c.hidden = 1").select("database", "table", F.col("c.name").alias("column"), F.row_number().over(by_ordinal).alias("position"), F.col("c.column_type_utf8").alias("data_type"), F.col("c.is_nullable").alias("is_nullable"), F.coalesce("pk", F.lit(False)).alias("is_primary_key"))


def health_reports(spark: SparkSession, path: str) -> DataFrame:
    """(file, status, total_pages, page_counts): damaged if any line fails, valid if pages were counted, else unknown."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    pairs = F.arrays_zip(F.regexp_extract_all("value", F.lit(r"(?m)^\s*(\d+)\s+([A-Za-z][\w ]*?)\s*$"), F.lit(1)).alias("n"), F.regexp_extract_all("value", F.lit(r"(?m)^\s*(\d+)\s+([A-Za-z][\w ]*?)\s*$"), F.lit(2)).alias("kind"))
    counted = text.withColumn("pairs", pairs)
    counts = F.map_from_entries(F.transform("pairs", lambda p: F.struct(p["kind"], p["n"].cast("long"))))
    status = F.when(F.col("value").rlike(r"(?i)\bfail"), "damaged").when(F.size("pairs") > 0, "valid").otherwise("unknown")
    return counted.select("file", status.alias("status"), F.aggregate("pairs", F.lit(0).cast("long"), lambda a, p: a + p["n"].cast("long")).alias("total_pages"), counts.alias("page_counts"))


def log_index(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, repeated): the server's list in order by base name, and names that stand in it twice."""
    files = lines.filter(F.trim("line") != "").select(F.col("line_no").alias("seq"), basename(F.trim("line")).alias("file"))
    return files, files.groupBy("file").agg(F.count("*").alias("n")).filter("n > 1")


def inventory(listed: DataFrame, present: DataFrame, by: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """(by, file, status): every file of the server's list or the evidence by its base name, once: present, missing (listed, not
    there) or unlisted."""
    name = lambda df: df.select(*by, basename(F.col("file")).alias("file")).distinct()
    both = name(listed).withColumn("l_", F.lit(True)).join(name(present).withColumn("p_", F.lit(True)), [*by, "file"], "full_outer")
    return both.select(*by, "file", F.when(F.col("p_").isNull(), "missing").when(F.col("l_").isNull(), "unlisted").otherwise("present").alias("status"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, kind, size, sha256) of files in a folder; a file is one row, so files past 2 GB cannot be read this way."""
    kind = F.when(F.col("file").rlike(r"\.ibd$"), "tablespace").when(F.col("file").rlike(r"\.index$"), "log_index").when(F.col("file").rlike(r"\.\d+$"), "log").otherwise("other")
    return spark.read.format("binaryFile").load(path).select(basename(F.col("path")).alias("file"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256")).withColumn("kind", kind)


def verify(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected (file, sha256) against a manifest: verified, hash_mismatch or missing."""
    both = expected.select("file", F.col("sha256").alias("want")).join(found.select("file", "sha256"), "file", "left")
    return both.select("file", F.when(F.col("sha256").isNull(), "missing").when(F.col("sha256") == F.col("want"), "verified").otherwise("hash_mismatch").alias("status"))


def normalise(v: Column, data_type: Column, zone: str = "UTC") -> Column:
    """A logged VALUE in the form a snapshot has: ENUM ordinals as labels, dates with dashes, TIMESTAMP seconds as times, binary as undecodable."""
    base = F.lower(F.regexp_extract(data_type, r"^\s*([A-Za-z]+)", 1))
    labels = F.regexp_extract_all(data_type, F.lit(r"'((?:[^']|'')*)'"), F.lit(1))
    number = v["text"].cast("int")
    return (
        F.when(v["kind"].isin("null", "undecodable"), v)
        .when((base == "enum") & (v["kind"] == "int") & number.between(1, F.size(labels)), value("str", F.try_element_at(labels, number)))
        .when(base == "date", value("str", F.replace(v["text"], F.lit(":"), F.lit("-"))))
        .when((base == "timestamp") & (v["kind"] == "int"), value("ts", F.date_format(F.to_utc_timestamp(F.timestamp_seconds(v["text"].cast("long")), zone), "yyyy-MM-dd'T'HH:mm:ss'Z'")))
        .when(base.isin("blob", "binary", "varbinary", "tinyblob", "mediumblob", "longblob"), value("undecodable", "binary column"))
        .otherwise(v)
    )
