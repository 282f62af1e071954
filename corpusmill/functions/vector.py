"""Column expressions on vectors held as array<float>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_FLOOR = 1e-10


def norm(vector: Column) -> Column:
    wide = vector.cast("array<double>")
    return F.sqrt(F.aggregate(wide, F.lit(0.0), lambda total, x: total + x * x))


def unit_row(vector: Column) -> Column:
    """A stored vector scaled to length one; a zero vector stays zero."""
    scale = F.greatest(norm(vector), F.lit(NORM_FLOOR))
    return F.transform(vector.cast("array<double>"), lambda x: x / scale)


def unit_query(vector: Column) -> Column:
    """A query vector scaled to length one when it has any length."""
    length = norm(vector)
    wide = vector.cast("array<double>")
    return F.when(length > 0, F.transform(wide, lambda x: x / length)).otherwise(wide)
