"""Numeric helpers shared by operators and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_away(col: str | Column, digits: int) -> Column:
    """Round to ``digits`` places, half away from zero, on the binary value
    ``x · 10^digits`` (``F.round`` alone rounds the shortest decimal text,
    which disagrees on exact decimal ties such as 0.5031855).  Integer-place
    rounding of a double is exact, so this equals ``std::round(x·10^d)/10^d``,
    including the sign of a zero result (−0.0 for small negative inputs)."""
    c = (F.col(col) if isinstance(col, str) else col).cast("double")
    scale = float(10 ** digits)
    r = F.round(c * F.lit(scale), 0) / F.lit(scale)
    return F.when(c < 0, -F.abs(r)).otherwise(r)
