from ledgerline.functions import values as v
from ledgerline.sources import text

LOG = r"""# at 4
#260815 21:06:20 server id 1  end_log_pos 100 	Query	thread_id=13	exec_time=0
# original_commit_timestamp=1786820785000000 (2026-08-15 21:06:25.000000 CEST)
SET @@SESSION.GTID_NEXT= 'aa-bb:5'/*!*/;
use `shop`/*!*/;
CREATE TABLE `items` (id int)
# at 120
#260815 21:06:25 server id 1  end_log_pos 180 	Query	thread_id=14
BEGIN
/*!*/;
# at 200
#260815 21:06:26 server id 1  end_log_pos 300 	Write_rows: table id 87
### INSERT INTO `shop`.`orders`
### SET
###   @1=1
###   @2='a''b, c'
### INSERT INTO `shop`.`orders`
### SET
###   @1=2
###   @2=NULL
# at 300
#260815 21:06:27 server id 1  end_log_pos 400 	Update_rows: table id 87
### UPDATE `shop`.`orders`
### WHERE
###   @1=2
### SET
###   @1=2
###   @2=1.50
# at 400
#260815 21:06:28 server id 1  end_log_pos 431 	Xid = 99
COMMIT/*!*/;
# at 431
#260815 21:07:00 server id 1  end_log_pos 500 	Query	thread_id=15
BEGIN
# at 500
#260815 21:07:01 server id 1  end_log_pos 600 	Delete_rows: table id 87
### DELETE FROM `shop`.`orders`
### WHERE
###   @1=1
###   @2=0xAB
"""


def _write(path, content):
    path.write_text(content)
    return f"file://{path}"


def test_change_log(spark, tmp_path):
    notes = text.annotated(text.read_lines(spark, _write(tmp_path / "log.000001", LOG)))
    catalog = spark.createDataFrame([("shop", "orders", "id", 1), ("shop", "orders", "note", 2)], "database string, table string, column string, position int")
    events = text.change_log_events(notes, catalog)
    got = {(r.log_position, r.row_index): r for r in events.collect()}
    assert sorted(got) == [(200, 0), (200, 1), (300, 0), (500, 0)]
    assert tuple(got[200, 0].after["note"]) == ("str", "a'b, c") and got[200, 0].before is None
    assert tuple(got[200, 1].after["note"]) == ("null", None)
    assert sorted(got[300, 0].before) == ["id"] and tuple(got[300, 0].after["note"]) == ("dec", "1.50")
    assert got[500, 0].before["note"]["kind"] == "undecodable" and got[500, 0].thread_id == 15
    assert str(got[200, 0].ts) == "2026-08-15 19:06:26"
    marks = {r.start_position: r for r in text.transaction_markers(notes, events).collect()}
    assert [(p, m.status, m.event_positions, m.xid) for p, m in sorted(marks.items())] == [(120, "committed", [200, 300], 99), (431, "incomplete", [500], None)]
    assert [tuple(r) for r in text.table_creations(notes).collect()] == [("shop", "items", "log.000001", 4)]


def test_snapshot_dump(spark, tmp_path):
    dump = "\n".join([
        r"""INSERT INTO `shop`.`orders` (`id`, `note`, `price`) VALUES (1, 'it''s, "x" \'y\'', 2.50);""",
        'INSERT INTO `shop`.`orders` (`id`, `note`) VALUES (2, "q, ""w""");',
        "INSERT INTO `shop`.`orders` (`id`, `note`) VALUES (3, NULL, 0xFF);",
        "INSERT INTO `shop`.`orders` (`id`, `note`) VALUES (4, CURRENT);",
    ])
    rows, dropped = text.snapshot_inserts(text.read_lines(spark, _write(tmp_path / "dump.sql", dump)))
    got = {r["values"]["id"]["text"]: r["values"] for r in rows.collect()}
    assert sorted(got) == ["1", "2", "4"] and dropped.count() == 1
    assert got["1"]["note"]["text"] == "it's, \"x\" 'y'" and tuple(got["1"]["price"]) == ("dec", "2.50")
    assert tuple(got["4"]["note"]) == ("str", "CURRENT")


def test_dictionary_health_index_manifest(spark, tmp_path):
    d = '[{"object": {"dd_object": {"name": "t", "schema_ref": "db", "columns": [{"name": "b", "ordinal_position": 2, "column_type_utf8": "int", "is_nullable": true, "hidden": 1}, {"name": "a", "ordinal_position": 1, "column_type_utf8": "bigint", "is_nullable": false, "hidden": 1}, {"name": "x", "ordinal_position": 3, "column_type_utf8": "int", "is_nullable": false, "hidden": 2}], "indexes": [{"type": 1, "elements": [{"column_opx": 1, "hidden": false}, {"column_opx": 2, "hidden": true}]}]}}}]'
    cat = text.catalog_json(spark, _write(tmp_path / "t.json", d)).orderBy("position").collect()
    assert [(r.column, r.position, r.is_primary_key) for r in cat] == [("a", 1, True), ("b", 2, False)]
    (tmp_path / "h").mkdir()
    _write(tmp_path / "h" / "good", "PAGE TYPE COUNT\n  5  Index page\n  2  Undo log page\n")
    _write(tmp_path / "h" / "bad", "page 3: Fail; checksum\n  5  Index page\n")
    _write(tmp_path / "h" / "silent", "\n")
    assert {r.file: (r.status, r.total_pages) for r in text.health_reports(spark, f"file://{tmp_path}/h").collect()} == {"good": ("valid", 7), "bad": ("damaged", 5), "silent": ("unknown", 0)}
    files, twice = text.log_index(text.read_lines(spark, _write(tmp_path / "list", "/var/log/log.1\nC:\\logs\\log.2\n./log.1\n")))
    assert [r.file for r in files.orderBy("seq").collect()] == ["log.1", "log.2", "log.1"] and twice.collect()[0].file == "log.1"
    found = text.manifest(spark, f"file://{tmp_path}/h")
    want = spark.createDataFrame([("good", found.filter("file = 'good'").first().sha256), ("bad", "0"), ("none", "0")], "file string, sha256 string")
    assert {r.file: r.status for r in text.verify(found, want).collect()} == {"good": "verified", "bad": "hash_mismatch", "none": "missing"}


def test_normalise(spark):
    rows = [("int", "2", "enum('a','b''c')"), ("str", "2026:08:15", "date"), ("int", "1786820785", "timestamp"), ("str", "x", "blob"), ("int", "7", "int")]
    df = spark.createDataFrame(rows, "kind string, text string, t string").select(text.normalise(v.value("x", "y").withField("kind", v.F.col("kind")).withField("text", v.F.col("text")), v.F.col("t")).alias("v"))
    assert [tuple(r.v) for r in df.collect()] == [("str", "b''c"), ("str", "2026-08-15"), ("ts", "2026-08-15T19:06:25Z"), ("undecodable", "binary column"), ("int", "7")]
