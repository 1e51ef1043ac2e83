"""Colours of CSS as Columns: parsing, distance and brightness."""

from __future__ import annotations

from functools import reduce

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

RGBA = "struct<r:double,g:double,b:double,a:double>"
#: Names of colours by the CSS standard, those in common use: fixed values.
NAMES = {
    "black": "000000", "white": "ffffff", "red": "ff0000", "green": "008000", "blue": "0000ff", "yellow": "ffff00", "gray": "808080", "grey": "808080", "silver": "c0c0c0", "maroon": "800000", "navy": "000080",
    "teal": "008080", "olive": "808000", "purple": "800080", "lime": "00ff00", "aqua": "00ffff", "cyan": "00ffff", "fuchsia": "ff00ff", "magenta": "ff00ff", "orange": "ffa500", "whitesmoke": "f5f5f5", "snow": "fffafa", "ivory": "fffff0",
}


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parse(value: Column) -> Column:
    """r, g, b (0 to 255) and a (0 to 1) of a name, #rgb, #rgba, #rrggbb, #rrggbbaa, rgb() or rgba(); null for what is none."""
    names = F.create_map(*[F.lit(x) for k, h in NAMES.items() for x in (k, f"#{h}")])
    pattern = r"^rgba?\(\s*([0-9.]+)\s*[, ]\s*([0-9.]+)\s*[, ]\s*([0-9.]+)(?:\s*[,/]\s*([0-9.]+%?))?\s*\)$"
    made = lambda r, g, b, a: F.struct(r.alias("r"), g.alias("g"), b.alias("b"), a.alias("a"))

    def of_hex(h: Column) -> Column:
        byte = lambda k: F.conv(F.substring(h, 2 * k + 1, 2), 16, 10).cast("double")
        return F.when(h.isNotNull(), made(byte(0), byte(1), byte(2), F.when(F.length(h) == 8, byte(3) / 255).otherwise(1.0)))

    def of_call(v: Column) -> Column:
        part = lambda k: F.regexp_extract(v, pattern, k)
        share = F.when(part(4) == "", 1.0).when(F.endswith(part(4), F.lit("%")), F.rtrim(part(4), F.lit("%")).try_cast("double") / 100).otherwise(part(4).try_cast("double"))
        return F.when(v.rlike(pattern), made(*[part(k).try_cast("double") for k in (1, 2, 3)], share))

    def of(v: Column) -> Column:
        hexes = F.when(v.rlike("^#[0-9a-f]{3,4}$"), F.regexp_replace(F.substring(v, 2, 4), "(.)", "$1$1")).when(v.rlike("^#(?:[0-9a-f]{6}|[0-9a-f]{8})$"), F.substring(v, 2, 8))
        return F.when(v == "transparent", made(*(F.lit(0.0),) * 4)).otherwise(F.coalesce(_let(hexes, of_hex), of_call(v)))

    return _let(F.lower(F.btrim(value)), lambda v: _let(F.coalesce(F.try_element_at(names, v), v), of))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two colours, without their alpha."""
    square = lambda x: x * x
    return _let(F.struct(a.alias("a"), b.alias("b")), lambda p: F.sqrt(square(p["a"]["r"] - p["b"]["r"]) + square(p["a"]["g"] - p["b"]["g"]) + square(p["a"]["b"] - p["b"]["b"])))


def brightness(c: Column) -> Column:
    """0 to 1 with the weights of Rec. 601; null for a colour that is more clear than not."""
    return _let(c, lambda x: F.when(x["a"] >= 0.5, (0.299 * x["r"] + 0.587 * x["g"] + 0.114 * x["b"]) / 255))
