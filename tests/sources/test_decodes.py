import pytest

from ledgerline.sources import tables

SCHEMA = "case_id string, source_file string, log_position long"


def rows(spark, path):
    return sorted((r.case_id, r.source_file, r.log_position) for r in tables.read_decodes(spark, path).collect())


def test_publish_rename_replace_and_refuse(spark, tmp_path):
    path = f"file://{tmp_path}/case"
    frame = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    assert tables.published(spark, path) is None
    tables.publish_decode(frame(("A", "copy-log.1", 4), ("A", "copy-log.1", 8)), path, "A", "log.1")
    tables.publish_decode(frame(("A", "copy-log.2", 4)), path, "A", "log.2")
    want = [("A", "log.1", 4), ("A", "log.1", 8), ("A", "log.2", 4)]
    assert rows(spark, path) == want
    with pytest.raises(ValueError, match="events from 2 files"):
        tables.publish_decode(frame(("A", "x-log.1", 4), ("A", "x-log.2", 4)), path, "A", "log.1")
    with pytest.raises(ValueError, match="holds rows of another"):
        tables.publish_decode(frame(("B", "x-log.1", 4)), path, "A", "log.1")
    assert rows(spark, path) == want
    # again: replaces that file's rows and no other's
    tables.publish_decode(frame(("A", "again-log.1", 9)), path, "A", "log.1")
    assert rows(spark, path) == [("A", "log.1", 9), ("A", "log.2", 4)]
    # a job that died before its manifest row
    frame(("A", "log.3", 1)).selectExpr("*", "source_file as read_as").write.parquet(f"{path}/decodes/decode=dead")
    assert rows(spark, path) == [("A", "log.1", 9), ("A", "log.2", 4)]
    # an empty decode is a decode
    tables.publish_decode(frame(), path, "A", "log.2")
    assert rows(spark, path) == [("A", "log.1", 9)]
