"""Columns that vector operators share: which vectors count, and their integer components."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(e: Column) -> Column:
    """Whether a vector is not null and holds neither nulls nor components that are not finite."""
    each = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(e.isNotNull() & each, F.lit(False))


def floored(e: Column, scale: int, share: int) -> Column:
    """``floor(scale * x)`` of each component as an int, cut off at the largest number of which ``share`` squares for each
    component stay below 2 ** 63, so that sums of products are exact in 64 bits."""
    limit = F.least(F.lit(float(2**31 - 1)), F.floor(F.sqrt(F.lit(2.0**63 / share) / F.greatest(F.size(e), F.lit(1)))) - 1)
    return F.transform(e, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, limit), -limit)).cast("int"))
