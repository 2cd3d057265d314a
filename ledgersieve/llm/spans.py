"""All matches of a pattern with their places, by built-in functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPAN = "array<struct<start:int,end:int,found:string>>"


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches, which must not be empty: ``start`` and ``end`` in code points, ``found``.

    The pieces between the matches and the matches themselves alternate, so adding up their
    lengths gives the places.  Texts without a match are not split.
    """
    pieces = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("spans"))

    def add(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(pair["piece"])
        end = begin + F.length(pair["found"])
        span = F.struct(begin.alias("start"), end.alias("end"), pair["found"].alias("found"))
        return F.struct(end.alias("at"), F.array_append(state["spans"], span).alias("spans"))

    pairs = F.transform(found, lambda m, i: F.struct(F.get(pieces, i).alias("piece"), m.alias("found")))
    return F.when(text.rlike(pattern), F.aggregate(pairs, start, add)["spans"]).otherwise(F.array().cast(_SPAN))
