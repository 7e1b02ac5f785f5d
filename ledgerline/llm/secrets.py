"""Secret scans over every historical version of every file, through an incremental blob ledger.

A version's content is addressed by its SHA-256. The ledger remembers which (blob, rule version)
pairs were scanned and what was found, so a run reads only pairs it has not seen, once however many
paths hold the blob, and findings go back to all paths by a join. All of it is DataFrame expressions.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


@dataclass(frozen=True)
class Rule:
    """pattern: what to find, leftmost and non-overlapping. group, least: a match counts if that group has so many characters.
    hint: a cheaper pattern that every text with a match also matches."""

    kind: str
    pattern: str
    group: int
    least: int
    hint: str

    @property
    def version(self) -> str:
        return hashlib.sha256(f"{self.pattern}\0{self.group}\0{self.least}".encode()).hexdigest()[:16]


RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16}"),
    Rule("hex", r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24}"),
)


def _matches(text: Column, rule: Rule, no: int) -> Column:
    """Array of (kind_no, seq, gap, size, ok): every match in order, with the code points between it and the one before."""
    # a run of 24 hex digits or more is found whole by the bounded pattern too, without listing the short ones
    pattern = rule.pattern if rule.group else rule.pattern[:-1] + f"{{{rule.least - (4 if rule.kind == 'access' else 0)},}}"
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group))
    # each list is made once, outside of any function of an element, which would make it again for each match
    parts = F.zip_with(hits, held, lambda hit, part: F.struct(F.length(hit).alias("size"), (F.length(part) >= rule.least).alias("ok")))
    rows = F.zip_with(parts, gaps, lambda part, gap: F.struct(F.length(gap).alias("gap"), part["size"].alias("size"), part["ok"].alias("ok")))
    # what follows the last match has no size; the hint also holds for some texts without any match
    return F.transform(
        F.filter(rows, lambda m: m["size"].isNotNull()),
        lambda m, i: F.struct(F.lit(no).alias("kind_no"), (i + 1).alias("seq"), m["gap"].alias("gap"), m["size"].alias("size"), m["ok"].alias("ok")),
    )


def scan(blobs: DataFrame, rules=RULES) -> DataFrame:
    """blobs: (blob, text, todo: array of rule kinds still to run). Returns (blob, kind_no, start, end), code points, end exclusive."""
    empty = F.expr("cast(array() as array<struct<kind_no:int,seq:int,gap:int,size:int,ok:boolean>>)")
    found = None
    for no, rule in enumerate(rules):
        due = F.array_contains("todo", rule.kind) & F.col("text").rlike(rule.hint)
        expr = F.when(due, _matches(F.col("text"), rule, no)).otherwise(empty)
        found = expr if found is None else F.concat(found, expr)
    rows = blobs.select("blob", F.explode(found).alias("m")).select("blob", "m.*")
    upto = Window.partitionBy("blob", "kind_no").orderBy("seq")
    return (
        rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto))
        .filter("ok")
        .select("blob", "kind_no", (F.col("end") - F.col("size")).alias("start"), "end")
    )


def ledger_scan(versions: DataFrame, ledger: DataFrame | None = None, rules=RULES, path_col: str = "doc_id", text_col: str = "text"):
    """Scan what the ledger has not seen.

    versions: one row per (path, historical version); null text is the empty text. ledger: what an earlier call
    returned, or None. Returns (findings, ledger): findings has path, blob and spans, an array of
    (start, kind_no, end) in order, empty where nothing was found, one row for each row of versions, null
    and repeated paths included. ledger has (blob, kind, version, spans), one row for each pair scanned. An empty table
    gives empty findings and leaves the ledger as it was. Texts of any length are scanned whole, equal ones once; no
    other column is read, so names that clash with an operator's do no harm.
    """
    seen = versions.select(F.col(path_col).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    distinct = seen.groupBy("blob").agg(F.first("text").alias("text"))
    pairs = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.lit(no).alias("kind_no")) for no, r in enumerate(rules)])
    if ledger is None:
        todo = distinct.withColumn("todo", F.array(*[F.lit(r.kind) for r in rules]))
    else:
        known = ledger.groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("known"))
        due = F.transform(F.filter(pairs, lambda p: ~F.array_contains(F.coalesce("known", F.expr("cast(array() as array<struct<kind:string,version:string>>)")), F.struct(p["kind"].alias("kind"), p["version"].alias("version")))), lambda p: p["kind"])
        todo = distinct.join(known, "blob", "left").withColumn("todo", due).drop("known").filter(F.size("todo") > 0)
    spans = scan(todo, rules).groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "kind_no", "end"))).alias("spans"))
    new = cut(spans)
    done = seen.select("blob").distinct() if ledger is None else todo.select("blob", "todo")
    rule_of = F.array(*[F.lit(r.kind) for r in rules])
    fresh = (
        done.join(new, "blob", "left")
        .select("blob", F.explode(pairs if ledger is None else F.filter(pairs, lambda p: F.array_contains("todo", p["kind"]))).alias("p"), "spans")
        .select("blob", "p.kind", "p.version", F.filter(F.coalesce("spans", F.expr("cast(array() as array<struct<start:bigint,kind_no:int,end:bigint>>)")), lambda s: F.element_at(rule_of, s["kind_no"] + 1) == F.col("p.kind")).alias("spans"))
    )
    out_ledger = fresh if ledger is None else ledger.unionByName(fresh)
    if ledger is None:
        hits = new
    else:
        now = F.transform(F.filter(pairs, lambda p: (p["kind"] == F.col("kind")) & (p["version"] == F.col("version"))), lambda p: p["kind_no"])
        hits = out_ledger.filter(F.size(now) > 0).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")).filter(F.size("spans") > 0)
    none = F.expr("cast(array() as array<struct<start:bigint,kind_no:int,end:bigint>>)")
    findings = seen.select("path", "blob").join(hits, "blob", "left").select("path", "blob", F.coalesce("spans", none).alias("spans"))
    return findings, out_ledger


def _count(kind_no: int) -> Column:
    # the function takes the span alone: a second parameter, with a default or not, would be given the span's index
    return F.size(F.filter("spans", lambda s: s["kind_no"] == kind_no)).cast("long")


def digest(findings: DataFrame, rules=RULES) -> DataFrame:
    """(doc_id, n_<kind>, base_sha256, spans) from findings."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    said = F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", F.element_at(kinds, s["kind_no"] + 1), s["start"].cast("string"), s["end"].cast("string"))))
    count = [_count(no).alias(f"n_{r.kind}") for no, r in enumerate(rules)]
    return findings.select(F.col("path").alias("doc_id"), *count, F.sha2(said, 256).alias("base_sha256"), said.alias("spans"))
