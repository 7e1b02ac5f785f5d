"""The VALUE column type and everything that judges or renders one value.

VALUE is struct<kind:string, text:string>; kind is int, dec, str, bool, ts, ts_naive, float, null or undecodable.
A column that is absent from a row image (a null VALUE) was not observed, which is not the same as SQL NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VALUE = "struct<kind:string,text:string>"
IMAGE = f"map<string,{VALUE}>"

# Column types whose decoding has been validated.
SUPPORTED = (
    "tinyint", "smallint", "mediumint", "int", "integer", "bigint", "decimal", "numeric", "char", "varchar", "text",
    "tinytext", "mediumtext", "longtext", "date", "datetime", "timestamp", "enum",
)

# Rule ids of a comparison.
EQUALITY, FLOAT, BYTES, NAIVE, UNDECODABLE, UNOBSERVED, TYPE, CROSS = (f"R-VAL-00{n}" for n in range(1, 9))

PLAIN_NUMBER = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)\s*$"


def value(kind: str, text) -> Column:
    return F.struct(F.lit(kind).alias("kind"), (text if isinstance(text, Column) else F.lit(text)).cast("string").alias("text"))


def of(column: Column, kind: str) -> Column:
    """VALUE of a column; SQL NULL where it is null."""
    return F.when(column.isNull(), value("null", None)).otherwise(value(kind, column))


def base_type(declared: Column) -> Column:
    """The leading word of a declared type, in lower case."""
    word = F.regexp_extract(declared, r"^\s*([A-Za-z]+)", 1)
    return F.lower(F.when(word != "", word).otherwise(F.trim(declared)))


def is_supported(declared: Column) -> Column:
    return base_type(declared).isin(*SUPPORTED)


def numeric(v: Column) -> Column:
    """Exact canonical text of a number of any length, or null. Strings that read as plain numbers count; bool does not."""
    text = F.trim(v["text"])
    digits = F.regexp_replace(text, r"^[+-]", "")
    whole = F.regexp_replace(F.substring_index(digits, ".", 1), "^0+", "")
    part = F.when(F.instr(digits, ".") > 0, F.regexp_replace(F.substring_index(digits, ".", -1), "0+$", "")).otherwise("")
    body = F.concat(F.when(whole == "", F.lit("0")).otherwise(whole), F.when(part == "", F.lit("")).otherwise(F.concat(F.lit("."), part)))
    signed = F.when(F.startswith(text, F.lit("-")) & (body != "0"), F.concat(F.lit("-"), body)).otherwise(body)
    return F.when(v["kind"].isin("int", "dec", "str") & v["text"].rlike(PLAIN_NUMBER), signed)


def compare(a: Column, b: Column, declared: Column | None = None, x: Column | None = None, y: Column | None = None) -> Column:
    """struct<comparable, equal, rule>: the first reason in fixed order that decides. declared: refuse types not validated.
    x, y: numeric(a) and numeric(b) where they are columns already."""

    def said(comparable, equal, rule: str) -> Column:
        equal = equal if isinstance(equal, Column) else F.lit(equal).cast("boolean")
        return F.struct(F.lit(comparable).alias("comparable"), equal.alias("equal"), F.lit(rule).alias("rule"))

    def either(*kinds: str) -> Column:
        return a["kind"].isin(*kinds) | b["kind"].isin(*kinds)

    x, y = numeric(a) if x is None else x, numeric(b) if y is None else y
    out = F.when(F.lit(False), said(False, None, TYPE)) if declared is None else F.when(~is_supported(declared), said(False, None, TYPE))
    return (
        out.when((F.coalesce(a["kind"], F.lit("")) == "undecodable") | (F.coalesce(b["kind"], F.lit("")) == "undecodable"), said(False, None, UNDECODABLE))
        .when(a.isNull() | b.isNull(), said(False, None, UNOBSERVED))
        .when(either("float"), said(False, None, FLOAT))
        .when((a["kind"] == "null") & (b["kind"] == "null"), said(True, True, EQUALITY))
        .when(either("null"), said(True, False, EQUALITY))
        .when(either("ts", "ts_naive") & ~(a["kind"].isin("ts", "ts_naive") & b["kind"].isin("ts", "ts_naive")), said(False, None, CROSS))
        .when(either("ts_naive"), said(False, None, NAIVE))
        .when(either("ts"), said(True, F.to_timestamp(a["text"]) == F.to_timestamp(b["text"]), EQUALITY))
        .when(either("bool") & (a["kind"] != b["kind"]), said(False, None, CROSS))
        .when(either("bool"), said(True, a["text"] == b["text"], EQUALITY))
        .when(x.isNotNull() & y.isNotNull(), said(True, x == y, EQUALITY))
        .when((a["kind"] == "str") & (b["kind"] == "str"), said(True, a["text"] == b["text"], BYTES))
        .otherwise(said(False, None, CROSS))
    )


def alike(a: Column, b: Column) -> Column:
    """Whether two VALUEs are equal because kind and text are the same: no other reading can tell them apart."""
    plain = (a["kind"] == "null") | (a["kind"].isin("str", "bool") & a["text"].isNotNull()) | (a["kind"].isin("int", "dec") & a["text"].rlike(PLAIN_NUMBER))
    return F.coalesce(a.eqNullSafe(b) & plain, F.lit(False))


def compared(df: DataFrame, a: str, b: str, declared: str | None = None, into: str = "c", where: Column | None = None) -> DataFrame:
    """df with the comparison of two of its columns; the numbers are worked out once, beside it, and only for values that are not
    alike. where: rows that ask for it; others get null."""
    x, y, same = F.col(a), F.col(b), F.col(f"{into}_same")
    asked = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    held = df.withColumns({f"{into}_same": F.when(asked, alike(x, y))})
    held = held.withColumns({f"{into}_x": numeric(F.when(~same, x)), f"{into}_y": numeric(F.when(~same, y))})
    rule = F.when((x["kind"] == "str") & ~x["text"].rlike(PLAIN_NUMBER), F.lit(BYTES)).otherwise(F.lit(EQUALITY))
    equal = F.struct(F.lit(True).alias("comparable"), F.lit(True).alias("equal"), rule.alias("rule"))
    refused = F.lit(False) if declared is None else ~is_supported(F.col(declared))
    judged = compare(x, y, None if declared is None else F.col(declared), F.col(f"{into}_x"), F.col(f"{into}_y"))
    return held.withColumn(into, F.when(same & ~refused, equal).when(same.isNotNull(), judged)).drop(f"{into}_x", f"{into}_y", f"{into}_same")


def render(v: Column) -> Column:
    """What a reader sees: not observed, NULL, undecodable (reason), or the value."""
    return (
        F.when(v.isNull(), F.lit("not observed"))
        .when(v["kind"] == "null", F.lit("NULL"))
        .when(v["kind"] == "undecodable", F.concat(F.lit("undecodable ("), v["text"], F.lit(")")))
        .otherwise(v["text"])
    )


def render_key(v: Column) -> Column:
    """A key component's text; null where it cannot be a key: not observed, undecodable, NULL, bool or float."""
    return F.when(v["kind"].isin("int", "dec", "str", "ts", "ts_naive"), v["text"])


def record_pk(parts: Column) -> Column:
    return F.array_join(parts, "|")


def record_id(table: Column, parts: Column) -> Column:
    return F.concat(table, F.lit(":"), record_pk(parts))


def separator_collides(parts: Column) -> Column:
    """Whether a key component holds the separator, so that two keys could read alike."""
    return F.exists(parts, lambda p: F.contains(p, F.lit("|")))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def suffix(file: Column) -> Column:
    return F.element_at(F.split(basename(file), r"\."), -1)


def utc_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def canonical_map(m: Column) -> Column:
    """JSON of a map with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def digest(column: Column) -> Column:
    return F.sha2(column, 256)


def rule_text(template: Column, context: Column) -> Column:
    """The template with {name} replaced from a map of strings; the raw template if any name is left unfilled."""
    filled = F.aggregate(F.map_entries(context), template, lambda s, e: F.replace(s, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))
    return F.when(filled.rlike(r"\{[a-z_]+\}"), template).otherwise(filled)


def literal(text: Column, dialect: str) -> Column:
    """VALUE of a SQL literal. Dialect log: an unknown literal is undecodable; dialect snapshot: it stays text."""
    inner = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.substring(text, 2, 1 << 30), r".$", ""), "''", "'"), r"\\(.)", "$1")
    t = F.trim(text)
    other = value("undecodable", F.concat(F.lit("unrecognised literal "), t)) if dialect == "log" else value("str", t)
    return (
        F.when(F.upper(t) == "NULL", value("null", None))
        .when(t.rlike(r"^'.*'$|^\".*\"$"), value("str", inner))
        .when(t.rlike(r"^-?[0-9]+$"), value("int", t))
        .when(t.rlike(r"^-?[0-9]*\.[0-9]+$"), value("dec", t))
        .when(t.rlike(r"^0[xX][0-9A-Fa-f]+$"), value("undecodable", "binary literal"))
        .otherwise(other)
    )
