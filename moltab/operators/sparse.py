"""One-hot encoding in long form, for columns with any number of categories.

The wide encoder (:func:`moltab.operators.scaling.onehot_fit`) needs a column per
category, so its list has to reach the driver.  Here the dictionary stays a table
``(feature, value, index, n)``: indices are places in the order of (feature, value), and
the encoding is one row ``(key, feature, index)`` per value that occurs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moltab.operators.joins import join_hot
from moltab.operators.ordered import row_number
from moltab.session import stored


def _long(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    text = [F.col(c).cast("string").alias(c) for c in cols]
    return df.select(*keys, *text).unpivot(list(keys), list(cols), "feature", "value").where(F.col("value").isNotNull())


def onehot_dictionary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``feature, value, index, n``: every category with its 0-based index and its rows.
    Values are compared as text; nulls are no category."""
    counts = _long(df, [], cols).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    numbered = row_number(counts, "feature", tiebreak=["value"], out="index")
    return stored(numbered.select("feature", "value", (F.col("index") - 1).alias("index"), "n"), "onehot-dictionary")


def onehot_long(df: DataFrame, key: str, cols: Sequence[str], dictionary: DataFrame) -> DataFrame:
    """``key, feature, index``: the ones of the encoded matrix.  A null or a value that the
    dictionary does not know has no row (all zeros)."""
    rows = _long(df, [key], cols)
    total = dictionary.agg(F.sum("n").alias("n")).first()["n"] or 0
    return join_hot(rows, dictionary, ["feature", "value"], "n", total).select(key, "feature", "index")
