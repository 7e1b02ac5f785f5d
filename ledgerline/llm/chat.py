"""Chat formatting by incremental black-box rendering.

The template is any function from a list of (role, text) turns to one string. Rendering each successive prefix
of a conversation and comparing consecutive outputs locates the turns: what a longer prefix adds is that turn's
span. A template whose longer output does not start with the shorter one rewrites history, which is reported.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turns = list[tuple[str, str]]

MARK, END = "### ", " </turn>\n"
SPAN = "spans array<struct<role:string,start:int,text_start:int,text_end:int,end:int>>"
SCHEMA = f"conv_id long, n_turns long, formatted string, rewrites boolean, {SPAN}"


def escape(s: str) -> str:
    """Reversible, and free of the template's control strings."""
    return s.replace("\\", "\\\\").replace("#", "\\h").replace("<", "\\l").replace("\n", "\\n").replace(":", "\\c")


def unescape(s: str) -> str:
    back = {"\\": "\\", "h": "#", "l": "<", "n": "\n", "c": ":"}
    return re.sub(r"\\([\\hlnc])", lambda m: back[m[1]], s)


def marked(turns: Turns) -> str:
    """`### Role: text </turn>`, one turn a line; role and text escaped."""
    return "".join(f"{MARK}{escape(role)}: {escape(text)}{END}" for role, text in turns)


def spans(turns: Turns, template: Callable[[Turns], str]) -> tuple[str, list[tuple[int, int]], bool]:
    """The last output, each turn's (start, end) in it, and whether any step changed what stood before."""
    out, found, rewrites = template([]), [], False
    for n in range(1, len(turns) + 1):
        longer = template(turns[:n])
        if not longer.startswith(out):
            rewrites = True
        found.append((min(len(out), len(longer)), len(longer)))
        out = longer
    return out, found, rewrites


def format_conversations(rows: DataFrame, template: Callable[[Turns], str] = marked) -> DataFrame:
    """One row per conv_id: formatted text, spans of turns and of their texts in it (code points), rewrites.

    rows: conv_id, turn, role, text; null role or text is empty; turns in order of turn (nulls first), ties by role
    and text; a null conv_id is a conversation of its own. An empty table gives no rows. Where the template rewrites
    history, spans say how far each step's output reached, and text spans are those of the marks found.
    """

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for conv, turns in zip(batch.conv_id, batch.turns, strict=True):
                pairs = [(t["role"], t["text"]) for t in turns]
                text, found, rewrites = spans(pairs, template)
                where = []
                for (role, _), (a, b) in zip(pairs, found, strict=True):
                    at = text.find(": ", a, b)
                    cut_at = b - len(END) if text[a:b].endswith(END) else b
                    where.append({"role": role, "start": a, "text_start": at + 2 if at >= 0 else a, "text_end": cut_at, "end": b})
                out.append((conv, len(pairs), text, rewrites, where))
            yield pd.DataFrame(out, columns=["conv_id", "n_turns", "formatted", "rewrites", "spans"]).astype({"conv_id": "Int64"})

    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn), lambda a, b: F.when(_before(a, b), -1).when(_before(b, a), 1).otherwise(0)).alias("turns"))
    return grouped.mapInPandas(render, SCHEMA)


def _before(a, b):
    """Order of turns: null turn first, then turn, role, text."""
    ta, tb = F.coalesce(a["turn"], F.lit(-(2**63))), F.coalesce(b["turn"], F.lit(-(2**63)))
    return (ta < tb) | ((ta == tb) & ((a["role"] < b["role"]) | ((a["role"] == b["role"]) & (a["text"] < b["text"]))))


def digest(formatted: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Digests of turns and of the text under the loss mask, all read back from the formatted text by its spans."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for conv, text, where in zip(batch.conv_id, batch.formatted, batch.spans, strict=True):
                turns, loss = hashlib.sha256(), []
                for s in where:
                    role = unescape(text[s["start"] + len(MARK) : s["text_start"] - 2])
                    said = unescape(text[s["text_start"] : s["text_end"]])
                    turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    if role == loss_role:
                        loss.append(said)
                lost = "".join(loss)
                out.append((conv, len(where), turns.hexdigest(), len(lost), hashlib.sha256(lost.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
            yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})

    return formatted.select("conv_id", "formatted", "spans").mapInPandas(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
