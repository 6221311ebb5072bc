"""Match positions with built-in functions: code points, end exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, value>>.

    The pieces between the matches and the matches themselves alternate, so
    their lengths add up to positions. value is the given group. Texts without
    a match cost one search. pattern must not match the empty string.
    """
    p = F.lit(pattern)
    hits, pieces = F.regexp_extract_all(text, p, F.lit(0)), F.split(text, pattern, -1)
    values = hits if group == 0 else F.regexp_extract_all(text, p, F.lit(group))
    steps = F.arrays_zip(
        F.transform(hits, lambda x: F.length(x)).alias("n"),
        F.transform(F.slice(pieces, F.lit(1), F.size(hits)), lambda x: F.length(x)).alias("skip"),
        values.alias("value"),
    )
    span = "array<struct<start:int,end:int,value:string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(span).alias("found"))

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["skip"]
        end = begin + x["n"]
        one = F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["found"], F.array(one)).alias("found"))

    return F.when(text.rlike(pattern), F.aggregate(steps, start, add, lambda acc: acc["found"])).otherwise(F.array().cast(span))


def render(spans: Column) -> Column:
    """kind:start:end, comma-joined, by start and then by the rank of the kind.

    spans: array<struct<start, rank, kind, end, ...>>; the array sorts by start
    and rank because these fields come first.
    """
    return F.array_join(
        F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
