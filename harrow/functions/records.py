"""Functions over JSON records and longer texts: usage of tokens, diffs, globs and summaries of steps."""

from __future__ import annotations

import difflib
from functools import reduce
from itertools import islice

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from harrow.functions import spans as S
from harrow.functions import text as X

#: Names under which logs hold usage, and providers report counts: fixed values, the first that is there counts.
USAGE = ("usage", "token_usage", "tokenUsage")
INPUT = ("input_tokens", "inputTokens", "prompt_tokens", "promptTokens", "prompt_token_count", "promptTokenCount")
OUTPUT = ("output_tokens", "outputTokens", "completion_tokens", "completionTokens", "candidates_token_count", "candidatesTokenCount")
CACHED = ("cached_input_tokens", "cachedInputTokens", "cache_read_input_tokens", "cacheReadInputTokens", "cached_tokens", "cachedTokens", "cached_content_token_count", "cachedContentTokenCount")
CREATED = ("cache_creation_input_tokens", "cacheCreationInputTokens")
REASONED = ("reasoning_tokens", "reasoningTokens")
FIELDS = ("input", "output", "total", "cached", "cache_creation", "reasoning")
BLOCK_TYPES = ("captcha", "login-wall", "bot-detection", "rate-limit", "paywall", "geo-block", "other")


#: A key of USAGE with its object, which may hold objects of two more levels; and a JSON string.
_BLOCK = r"""(?<!\\)"(?:""" + "|".join(USAGE) + r""")"\s*:\s*\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\}"""
_STRING = r"\"(?:[^\"\\]|\\.)*\""


def _block(body: Column) -> Column:
    """The usage object of a JSON text that lies least deep, the last of equals; null for none."""
    spans = S.find(body, _BLOCK, "usage")

    def placed(s: Column) -> Column:
        before = F.regexp_replace(F.substring(body, F.lit(1), s["start"]), _STRING, "")
        depth = F.length(F.regexp_replace(before, r"[^{\[]", "")) - F.length(F.regexp_replace(before, r"[^}\]]", ""))
        said = F.substring(body, s["start"] + 1, s["end"] - s["start"])
        return F.struct(depth.alias("depth"), (-s["start"]).alias("back"), F.regexp_extract(said, r"(?s)\{.*", 0).alias("said"))

    return F.get(F.array_sort(F.transform(spans, placed)), F.lit(0))["said"]


def _named(name: str):
    return lambda entry: entry["key"] == name


def usage(body: Column | str) -> Column:
    """Token usage (FIELDS) of the usage object of a JSON text, at any depth; nulls where there is none, or no JSON.

    Of the names of a count the first in the list that the object has as a number counts, of input and output the first above
    zero; cached, created and reasoning tokens may also stand in an object within it. Of input and output one may be missing or
    zero; an object without either counts for nothing.
    """
    body = F.col(body) if isinstance(body, str) else body
    entries = lambda c: F.map_entries(F.from_json(c, "map<string,string>"))
    # Entries of the names that count, with their numbers.
    numbers = lambda found, names: F.transform(F.filter(found, lambda e: e["key"].isin(*names)), lambda e: F.struct(e["key"].alias("key"), e["value"].try_cast("double").alias("n")))
    pick = lambda found, names: F.coalesce(*[F.get(F.filter(found, _named(n)), F.lit(0))["n"].try_cast("long") for n in names])

    def placed(own: Column) -> Column:
        inner = F.flatten(F.transform(F.filter(own, lambda e: F.startswith(e["value"], F.lit("{"))), lambda e: F.coalesce(entries(e["value"]), F.array().cast("array<struct<key:string,value:string>>"))))
        return F.struct(F.filter(numbers(own, INPUT + OUTPUT), lambda e: e["n"] > 0).alias("io"), numbers(F.concat(own, inner), CACHED + CREATED + REASONED).alias("more"))

    def picked(x: Column) -> Column:
        return F.struct(pick(x["io"], INPUT).alias("i"), pick(x["io"], OUTPUT).alias("o"), *[pick(x["more"], names).alias(f) for f, names in zip(FIELDS[3:], (CACHED, CREATED, REASONED), strict=True)])

    def counted(x: Column) -> Column:
        i, o = F.coalesce(x["i"], F.lit(0)), F.coalesce(x["o"], F.lit(0))
        values = [i, o, i + o, *[x[f] for f in FIELDS[3:]]]
        return F.when(x["i"].isNotNull() | x["o"].isNotNull(), F.struct(*[v.cast("long").alias(f) for f, v in zip(FIELDS, values, strict=True)]))

    none = F.struct(*[F.lit(None).cast("long").alias(f) for f in FIELDS])
    # Each step is computed once, however often the next one names it.
    block = X.once(body, lambda text: F.when(F.try_parse_json(text).isNotNull(), _block(text)))
    return F.coalesce(X.once(block, lambda b: F.when(b.isNotNull(), X.once(X.once(X.once(entries(b), placed), picked), counted))), none)


#: Lines of a diff that are shown.
DIFF_LINES = 500


def unified_diff(a: Column, b: Column, most: int = DIFF_LINES) -> Column:
    """A line diff with three lines of context, its first ``most`` lines; empty for equal texts."""

    @F.pandas_udf("string")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        lines = lambda s: (s or "").split("\n")
        return pd.Series(["\n".join(islice(difflib.unified_diff(lines(p), lines(q), "a", "b", lineterm="", n=3), most)) for p, q in zip(x, y, strict=True)])

    return run(a, b)


def match_kind(a: Column, b: Column) -> Column:
    """Whether two trees are the same by hash, or which one is missing."""
    return F.when(a.isNull() & b.isNull(), "neither").when(a.isNull(), "only b").when(b.isNull(), "only a").when(F.sha2(a, 256) == F.sha2(b, 256), "same").otherwise("different")


def glob(column: Column, patterns: list[str]) -> Column:
    """Whether a value matches any shell pattern (* and ?); no patterns match all. Case counts."""
    if not patterns:
        return F.lit(True)
    regex = lambda p: "^" + "".join(".*" if c == "*" else "." if c == "?" else f"\\{c}" if not c.isalnum() and c not in "_-" else c for c in p) + "$"
    return reduce(lambda a, p: a | column.rlike(regex(p)), patterns, F.lit(False))


def block_type(kind: Column, blocked: Column) -> Column:
    low = F.lower(F.btrim(kind))
    return F.when(blocked, F.when(low.isin(*BLOCK_TYPES), low).otherwise("other"))


def summary(steps: Column, budget: int, low: int = 400, high: int = 1200) -> Column:
    """Steps (array of strings) cut to an equal share of the budget each, joined by lines, within the budget."""
    share = F.least(F.lit(high), F.greatest(F.lit(low), F.floor(F.lit(budget) / F.greatest(F.size(steps), F.lit(1))))).cast("int")
    cut = F.transform(steps, lambda s: F.when(F.length(s) > share, F.concat(F.left(s, share), F.lit("…"))).otherwise(s))
    return F.left(F.array_join(cut, "\n"), F.lit(budget))
