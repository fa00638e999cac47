"""Spans of pattern matches as Spark columns: where each match starts and ends, in code points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,value:string,before:string>>"
#: Characters kept from before a match.
CONTEXT = 24


def match_spans(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """All leftmost non-overlapping matches (start, end exclusive, value, what stands before it), in order; keep drops some afterwards.

    Positions come from the lengths of the matches and of the pieces between them. Texts without a match
    are scanned once.
    """
    pieces = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        end = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("value"), F.right(x["piece"], F.lit(CONTEXT)).alias("before"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    pairs = F.zip_with(pieces, hits, lambda p, h: F.struct(p.alias("piece"), h.alias("hit")))
    pairs = F.filter(pairs, lambda x: x["hit"].isNotNull())
    none = F.array().cast(SPAN)
    out = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), step)["out"]
    if keep is not None:
        out = F.filter(out, lambda x: keep(x["value"]))
    return F.when(text.rlike(pattern), out).otherwise(none)


def of_kind(spans: Column, kind: str, order: int) -> Column:
    """The spans with their kind and its place in the order of kinds."""
    return F.transform(
        spans, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("order"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"))
    )


def merged(kinds: list[Column]) -> Column:
    """Spans of several kinds by start, then by the order of kinds."""
    return F.array_sort(F.concat(*kinds))


def listed(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def number_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
