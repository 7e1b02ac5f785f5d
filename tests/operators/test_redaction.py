import pytest

from ledgerline.operators import redaction as rd

VAL = "struct<kind:string,text:string>"


def test_every_kind_of_value(spark):
    rows = [
        (1, "shop", {"id": ("int", "5"), "name": ("str", "ann"), "note": ("null", None), "blob": ("undecodable", "bad length")}, ("str", "ann"), "called at noon"),
        (2, "shop", {"id": ("str", "5"), "name": None}, ("null", None), None),
        (3, "Unknown", None, None, ""),
        (4, None, {}, ("undecodable", "binary column"), "x"),
        (5, "yard", {"name": ("str", "bob"), "id": ("int", "12")}, ("int", "5"), "y"),
    ]
    df = spark.createDataFrame(rows, f"n int, db string, image map<string,{VAL}>, v {VAL}, said string")
    other = spark.createDataFrame([("ann", "log.1"), ("shop", "log.2")], "who string, file string")
    out, named = rd.redact({"a": df, "b": other}, {"a": {"n": rd.KEEP, "db": "DATABASE", "image": rd.IMAGE, "v": rd.VALUE, "said": rd.WITHHOLD}, "b": {"who": "VALUE", "file": "SOURCE"}})
    got = {r.n: r for r in out["a"].collect()}
    assert {n: r.db for n, r in got.items()} == {1: "[DATABASE-001]", 2: "[DATABASE-001]", 3: "Unknown", 4: None, 5: "[DATABASE-002]"}
    fields = {"blob": "[FIELD-001]", "id": "[FIELD-002]", "name": "[FIELD-003]", "note": "[FIELD-004]"}
    values = {"12": "[VALUE-001]", "5": "[VALUE-002]", "ann": "[VALUE-003]", "bob": "[VALUE-004]", "shop": "[VALUE-005]"}
    assert {k: tuple(v) for k, v in got[1].image.items()} == {fields["id"]: ("alias", values["5"]), fields["name"]: ("alias", values["ann"]), fields["note"]: ("null", None), fields["blob"]: ("undecodable", rd.WITHHELD)}
    assert {k: v and tuple(v) for k, v in got[2].image.items()} == {fields["id"]: ("alias", values["5"]), fields["name"]: None}
    assert got[3].image is None and got[4].image == {} and got[3].v is None and tuple(got[4].v) == ("undecodable", rd.WITHHELD)
    assert tuple(got[1].v) == ("alias", values["ann"]) and tuple(got[5].v) == ("alias", values["5"]) and tuple(got[2].v) == ("null", None)
    assert [got[n].said for n in range(1, 6)] == [rd.WITHHELD, None, rd.WITHHELD, rd.WITHHELD, rd.WITHHELD]
    assert sorted(tuple(r) for r in out["b"].collect()) == [(values["ann"], "[SOURCE-001]"), (values["shop"], "[SOURCE-002]")]
    assert {(r.category, r.value) for r in named.collect()} >= {("VALUE", "ann"), ("FIELD", "id"), ("SOURCE", "log.1")}


def test_numbers_go_on_past_three_digits(spark):
    df = spark.range(1200).selectExpr("format_string('%05d', id) as v")
    out, _ = rd.redact({"a": df}, {"a": {"v": "VALUE"}})
    assert sorted(r.v for r in out["a"].collect()) == sorted(f"[VALUE-{n:03d}]" for n in range(1, 1201))


def test_a_column_without_a_rule_is_refused(spark):
    with pytest.raises(ValueError, match="no rule for a: secret"):
        rd.redact({"a": spark.createDataFrame([("x", "y")], "v string, secret string")}, {"a": {"v": "VALUE"}})


def test_empty(spark):
    df = spark.createDataFrame([], "v string")
    out, named = rd.redact({"a": df}, {"a": {"v": "VALUE"}})
    assert out["a"].isEmpty() and named.isEmpty()
