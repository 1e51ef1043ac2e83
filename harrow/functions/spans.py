"""Spans of text as arrays of (start, end, label): finding, merging and replacing. Offsets are code points, ends exclusive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,label:string>>"
#: ASCII word boundaries: Java's \b also looks at other letters.
B, E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def find(text: Column, pattern: str, label: str, accept: Callable[[Column], Column] | None = None) -> Column:
    """The leftmost non-overlapping matches of a pattern that ``accept`` holds for; only texts that match are split."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    both = F.filter(F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("gap"), m.alias("found"))), lambda x: x["found"].isNotNull())
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,found:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["found"])
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end"), x["found"].alias("found"))).alias("out"))

    places = F.aggregate(both, empty, step, lambda acc: acc["out"])
    good = places if accept is None else F.filter(places, lambda x: accept(x["found"]))
    named = F.transform(good, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(label).alias("label")))
    return F.when(text.rlike(pattern), named).otherwise(F.array().cast(SPAN))


def merge(*groups: Column) -> Column:
    """All spans by start, longest first among equals, without those that begin before the last kept one ends."""
    keyed = F.transform(F.concat(*groups), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["label"].alias("label")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, s: Column) -> Column:
        end = -s["back"]
        kept = F.array_append(acc["out"], F.struct(s["start"].alias("start"), end.alias("end"), s["label"].alias("label")))
        fits = s["start"] >= acc["at"]
        return F.struct(F.when(fits, end).otherwise(acc["at"]).alias("at"), F.when(fits, kept).otherwise(acc["out"]).alias("out"))

    return F.aggregate(F.array_sort(keyed), start, step, lambda acc: acc["out"])


def replace(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its label; spans must be merged."""
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        more = F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), s["label"])
        return F.struct(F.concat(acc["parts"], more).alias("parts"), s["end"].alias("at"))

    done = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(done)
