"""Vector functions over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalised(v: Column) -> Column:
    """Unit length; the zero vector stays as it is."""
    norm = F.sqrt(inner_product(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(v.cast("array<double>"))
