"""Redaction: names and values replaced by aliases that keep equality, through every level of a column's schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import ranked
from ..sources.tables import settle

#: What stands for text that is withheld.
WITHHELD = "[REDACTED]"
#: Markers that tell nothing and stay as they are.
OPEN = ("", "Unknown", WITHHELD)
#: What a column may be beside the name of a category: kept as it is, withheld, a VALUE, a map of VALUEs by column name.
KEEP, WITHHOLD, VALUE, IMAGE = "keep", "withhold", "value", "image"
_SEPARATOR = "\x1f"


def _hidden(value: Column) -> Column:
    """A VALUE whose text is to be replaced: observed, not NULL, decodable."""
    return value.isNotNull() & ~value["kind"].isin("null", "undecodable")


def _terms(column: Column, rule: str) -> Column:
    """Array of struct(category, value) that a column holds."""
    term = lambda category, v: F.struct(F.lit(category).alias("category"), v.cast("string").alias("value"))
    if rule == VALUE:
        return F.when(_hidden(column), F.array(term("VALUE", column["text"])))
    if rule == IMAGE:
        entries = F.map_entries(column)
        return F.concat(F.transform(entries, lambda e: term("FIELD", e["key"])), F.transform(F.filter(entries, lambda e: _hidden(e["value"])), lambda e: term("VALUE", e["value"]["text"])))
    return F.when(~column.cast("string").isin(*OPEN), F.array(term(rule, column)))


def _rewritten(column: Column, rule: str, alias) -> Column:
    """column with aliases in place. alias: function of (category, value)."""
    if rule == WITHHOLD:
        return F.when(column.isNotNull(), F.lit(WITHHELD))
    image = lambda v: F.when(v.isNull() | (v["kind"] == "null"), v).when(v["kind"] == "undecodable", F.struct(v["kind"].alias("kind"), F.lit(WITHHELD).alias("text"))).otherwise(F.struct(F.lit("alias").alias("kind"), alias("VALUE", v["text"]).alias("text")))
    if rule == VALUE:
        return image(column)
    if rule == IMAGE:
        return F.map_from_entries(F.transform(F.map_entries(column), lambda e: F.struct(alias("FIELD", e["key"]).alias("key"), image(e["value"]).alias("value"))))
    text = column.cast("string")
    return F.when(text.isNull() | text.isin(*OPEN), text).otherwise(alias(rule, text))


def _per_row(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(row_, category, value): every distinct term of each row."""
    told = [_terms(F.col(f"`{c}`"), r) for c, r in rules.items() if r not in (KEEP, WITHHOLD)]
    none = F.expr("cast(array() as array<struct<category:string,value:string>>)")
    every = F.concat(none, *[F.coalesce(t, none) for t in told])
    return df.select("row_", F.explode(F.array_distinct(every)).alias("t")).select("row_", "t.category", "t.value").filter("value is not null")


def dictionary(terms: DataFrame) -> DataFrame:
    """(category, value, alias): values of a category numbered from 1 in code point order, [CATEGORY-001] and on.

    Numbers come from sorted ranges and their sizes, so no category is one task.
    """
    placed = ranked(terms.select("category", "value").distinct(), [F.col("value")], "n", "category")
    number = (F.col("n") + 1).cast("string")
    shown = F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)
    return placed.select("category", "value", F.concat(F.lit("["), "category", F.lit("-"), shown, F.lit("]")).alias("alias"))


def redact(frames: dict[str, DataFrame], rules: dict[str, dict[str, str]]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(redacted frames, dictionary): every column of every frame by its rule; a column without one is an error.

    rules: for each frame and column keep (allow-listed), withhold (free text: only that it was there is told), value or image
    (a VALUE, or VALUEs by column name, which become FIELD aliases), or a category. Equal values of a category have one alias
    in all frames, whatever their type; SQL NULL, columns not observed, and markers of nothing known stay; of an undecodable
    value only that it was one. A row meets the dictionary by its own distinct terms and takes back one small map, so a term that
    most rows hold is a join with one row on the other side, which Spark splits or broadcasts by size.
    """
    for name, df in frames.items():
        if missing := set(df.columns) - set(rules[name]):
            raise ValueError(f"no rule for {name}: {', '.join(sorted(missing))}")
    kept = {name: settle(df.withColumn("row_", F.monotonically_increasing_id())) for name, df in frames.items()}
    terms = {name: _per_row(df, rules[name]) for name, df in kept.items()}
    named = settle(dictionary(reduce(DataFrame.unionByName, [t.select("category", "value") for t in terms.values()])))

    def one(name: str) -> DataFrame:
        key = F.concat("category", F.lit(_SEPARATOR), "value")
        own = terms[name].join(named, ["category", "value"]).groupBy("row_").agg(F.map_from_entries(F.collect_list(F.struct(key, "alias"))).alias("aliases_"))
        alias = lambda category, v: F.col("aliases_")[F.concat(F.lit(category + _SEPARATOR), v)]
        return kept[name].join(own, "row_", "left").select(*[F.col(f"`{c}`") if r == KEEP else _rewritten(F.col(f"`{c}`"), r, alias).alias(c) for c, r in rules[name].items() if c in frames[name].columns])

    return {name: one(name) for name in frames}, named
