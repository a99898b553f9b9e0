"""Joins that keep a hot key out of a single task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than one in so many of all rows is hot; there are at most so many.
HOT = 1024


def join_hot(rows: DataFrame, one: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``one``, which is unique on ``on`` and whose column
    ``size`` says how many of the ``total`` rows have the key.  Keys with more than one in
    ``HOT`` rows are broadcast (fewer than ``HOT`` rows, whatever the data), so no task
    gets such a key as a whole; the others are joined as Spark sees fit."""
    hot = F.col(size) * HOT > F.lit(total)
    return rows.join(F.broadcast(one.where(hot).drop(size)), on) \
        .unionByName(rows.join(one.where(~hot).drop(size), on))
