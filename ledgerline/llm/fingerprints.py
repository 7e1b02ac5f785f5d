"""Document fingerprints: a Merkle tree over paragraphs and sections, in expressions alone.

A text is cut into sections (up to eight lines, ended early by an empty line), these into paragraphs (a line with the
line breaks behind it) and these into pieces of 24 to 96 code points that end where the text itself says so. No code
point is left out, so equal roots mean equal texts. A node's hash is that of its children's hashes; a fingerprint writes
the tree out, and two of them are compared branch by branch: equal branches need no look inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import ranked
from .common import texts

SECTION = r"(?:[^\n]+\n){1,7}[^\n]*\n*|[^\n]+|\n+"
PARAGRAPH = r"[^\n]*\n+|[^\n]+"
#: Up to a space behind a punctuation mark or one of three letters, else 96 code points.
PIECE = r"(?s).{24,96}?[lrt.,;:!?][ \t\n\r\f]|.{1,96}"
#: Characters of a node's hash in the fingerprint: base64 of its first 48 bits.
SHORT = 8
LEAF = r"\.([^.,;|]{8})"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _short(hashed: Column) -> Column:
    return F.base64(F.unhex(F.substring(hashed, 1, 12)))


def _over(hashes: Column) -> Column:
    return F.md5(F.array_join(hashes, "").cast("binary"))


def tree(text: Column) -> Column:
    """array<struct<hash, paragraphs array<struct<hash, leaves array<string>>>>>, one entry for each section of a text; the
    empty text has none, a null text no tree."""
    leaves = lambda paragraph: F.transform(_all(paragraph, PIECE), lambda piece: F.md5(piece.cast("binary")))
    paragraph = lambda hashes: F.struct(_over(hashes).alias("hash"), F.transform(hashes, _short).alias("leaves"))
    section = lambda kept: F.struct(_over(F.transform(kept, lambda p: p["hash"])).alias("hash"), kept.alias("paragraphs"))
    paragraphs = lambda part: F.transform(F.transform(_all(part, PARAGRAPH), leaves), paragraph)
    return F.transform(F.transform(_all(text, SECTION), paragraphs), section)


def written(tree_: Column) -> Column:
    """The fingerprint of a tree: the root's SHA-256, then |section,paragraph.leaf.leaf,paragraph...;section..."""
    root = F.sha2(F.array_join(F.transform(tree_, lambda s: s["hash"]), "").cast("binary"), 256)
    paragraph = lambda p: F.concat(F.lit(","), _short(p["hash"]), F.lit("."), F.array_join(p["leaves"], "."))
    sections = F.transform(tree_, lambda s: F.concat(_short(s["hash"]), F.array_join(F.transform(s["paragraphs"], paragraph), "")))
    return F.concat(root, F.lit("|"), F.array_join(sections, ";"))


def root(fingerprint: Column) -> Column:
    return F.substring_index(fingerprint, "|", 1)


def leaves(fingerprint: Column) -> Column:
    """Distinct leaves of a fingerprint."""
    return F.array_distinct(F.regexp_extract_all(fingerprint, F.lit(LEAF), F.lit(1)))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal roots; else the share of common leaves in all distinct leaves of both fingerprints, 0 where there is none."""
    # each step is bound to a variable of its own, so no leaf is read from the text twice
    sets = F.transform(F.array(F.struct(leaves(a).alias("x"), leaves(b).alias("y"))), lambda s: F.struct(F.size(F.array_intersect(s["x"], s["y"])).alias("both"), (F.size(s["x"]) + F.size(s["y"])).alias("sum")))
    share = F.element_at(F.transform(sets, lambda s: s["both"] / (s["sum"] - s["both"]).cast("double")), 1)
    return F.when(root(a) == root(b), F.lit(1.0)).otherwise(share)


def edits(a: Column, b: Column) -> Column:
    """array<struct<section, paragraph, leaves>>: where fingerprint b has something that a has not.

    Only sections of b that a lacks are opened, in these only paragraphs that a lacks, and of these the places of the
    leaves that a lacks are listed (numbers from 0, paragraphs within their section). Moved branches are no edit.
    """
    parts = lambda f: F.split(F.substring_index(f, "|", -1), ";")
    head = lambda part: F.substring(part, 1, SHORT)
    inner = lambda part: F.slice(F.split(part, ","), 2, 1 << 30)
    known = F.transform(parts(a), head)
    lines = F.flatten(F.transform(parts(a), lambda s: F.transform(inner(s), head)))
    seen = leaves(a)
    section = lambda s, i: F.when(~F.array_contains(known, head(s)), F.filter(F.transform(inner(s), lambda p, j: F.when(~F.array_contains(lines, head(p)), F.struct(i.alias("section"), j.alias("paragraph"), F.filter(F.transform(F.slice(F.split(p, r"\."), 2, 1 << 30), lambda x, n: F.when(~F.array_contains(seen, x), n)), lambda n: n.isNotNull()).alias("leaves")))), lambda e: e.isNotNull()))
    found = F.flatten(F.filter(F.transform(parts(b), section), lambda x: x.isNotNull()))
    return F.when((root(a) == root(b)) | (F.substring_index(b, "|", -1) == ""), F.expr("cast(array() as array<struct<section:int,paragraph:int,leaves:array<int>>>)")).otherwise(found)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, fingerprint) of every row; a null text counts as the empty one, whose fingerprint has no branches.

    Equal texts, in whatever rows, have equal fingerprints. Repeated rows and null ids stay rows, other columns are left
    out whatever their names, an empty table gives an empty result; a text is one row's work, linear in its length.
    """
    return texts(docs, id_col, text_col).withColumn("fingerprint", written(tree(F.col("text"))))


def changed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, fingerprint, edited, edited_fingerprint, next_fingerprint) of every row of docs.

    edited is the text with its last floor(n/2) code points replaced by as many from the start of the next document (all
    of it, if it is shorter). Next is by descending doc_id, null ids last, equal ids by a hash of the text; after the last
    comes the first, so a document alone is its own next. Rows equal in id and text are one document here, and each of
    them is returned. An empty table gives an empty result.

    Only ids and sizes are sorted. Texts meet their successor's start by two joins over one shuffle of the texts; what
    travels beside it is a fingerprint and the half text that is needed.
    """
    named = [F.coalesce("doc_id", F.lit(0)).alias("k"), F.xxhash64("text", F.col("doc_id").isNull()).alias("h")]
    each = texts(docs).select("doc_id", *named, F.length("text").alias("n")).groupBy("doc_id", "k", "h").agg(F.max("n").alias("n"), F.count("*").alias("copies"))
    placed = ranked(each.withColumn("all_", F.lit(0)), [F.col("doc_id").isNull(), F.bitwise_not("k"), F.col("h")], within="all_").drop("all_")
    total = placed.agg(F.count("*").alias("n"), F.max("copies").alias("copies")).first()
    following = F.when(F.col("ordinal") + 1 < total["n"], F.col("ordinal") + 1).otherwise(F.lit(0))
    wanted = placed.select(following.alias("ordinal"), "doc_id", F.col("k").alias("for_k"), F.col("h").alias("for_h"), F.floor(F.col("n") / 2).cast("int").alias("need"))
    pairs = placed.select("ordinal", "k", "h").join(wanted, "ordinal").drop("ordinal")
    # both joins read the same columns of it, so its shuffle is written once
    spread = fingerprints(docs).select(*named, "text", "fingerprint").repartition("k", "h")
    starts = spread.join(pairs, ["k", "h"]).select("doc_id", F.col("for_k").alias("k"), F.col("for_h").alias("h"), F.expr("substring(text, 1, need)").alias("start"), F.col("fingerprint").alias("next_fingerprint"))
    if total["copies"] and total["copies"] > 1:
        starts = starts.groupBy("doc_id", "k", "h").agg(F.first("start").alias("start"), F.first("next_fingerprint").alias("next_fingerprint"))
    n = F.length("text")
    edited = F.concat(F.substr("text", F.lit(1), n - F.floor(n / 2).cast("int")), F.col("start"))
    met = spread.join(starts, ["k", "h"]).select("doc_id", "text", "fingerprint", edited.alias("edited"), "next_fingerprint")
    return met.withColumn("edited_fingerprint", written(tree(F.col("edited"))))


def digest(changed_: DataFrame) -> DataFrame:
    return changed_.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
