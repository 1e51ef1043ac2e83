"""Numbers as reports show them; null, and a difference from nothing, is a dash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "—"


def _or_dash(x: Column, shown: Column) -> Column:
    return F.when(x.isNull(), DASH).otherwise(shown)


def _signed(x: Column, shown: Column) -> Column:
    return F.when(x < 0, shown).otherwise(F.concat(F.lit("+"), shown))


def integer(x: Column) -> Column:
    """Rounded half to even, with thousands."""
    return _or_dash(x, F.format_number(F.bround(x.cast("double"), 0), 0))


def money(x: Column) -> Column:
    return _or_dash(x, F.format_string("$%.4f", x.cast("double")))


def seconds(x: Column) -> Column:
    return _or_dash(x, F.format_string("%.1fs", x.cast("double")))


def percent_change(a: Column, b: Column) -> Column:
    """From a to b, signed and without decimals."""
    p = F.bround((b - a) / F.nullif(a.cast("double"), F.lit(0.0)) * 100, 0)
    return _or_dash(p, F.format_string("%+.0f%%", p))


def change(a: Column, b: Column, kind: str = "int") -> Column:
    """b - a, signed: a number with thousands (int), money or seconds (secs)."""
    d = (b - a).cast("double")
    shown = {"int": _signed(F.bround(d, 0), F.format_number(F.bround(d, 0), 0)), "money": F.format_string("%+.4f", d), "secs": F.format_string("%+.1fs", d)}[kind]
    return _or_dash(d, shown)
