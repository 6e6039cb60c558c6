"""Vector expressions over arrays, and their blocked counterpart for all pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def l2_normalize(v: Column, eps: float = 1e-12) -> Column:
    return F.transform(v, lambda x: x.cast("double") / F.greatest(F.sqrt(dot(v, v)), F.lit(eps)))


def masked_mean(states: Column, mask: Column) -> Column:
    """Mean vector of the positions whose mask is not 0; zeros if there is none."""
    kept = F.transform(F.filter(F.arrays_zip(states.alias("s"), mask.alias("m")), lambda p: p["m"] != 0), lambda p: p["s"])
    n = F.greatest(F.size(kept).cast("double"), F.lit(1e-9))
    zero = F.transform(F.get(states, F.lit(0)), lambda x: F.lit(0.0))
    total = F.aggregate(kept, zero, lambda acc, v: F.zip_with(acc, v, lambda a, x: a + x.cast("double")))
    return F.transform(total, lambda x: x / n)


def first_position(states: Column) -> Column:
    return F.get(states, F.lit(0))
