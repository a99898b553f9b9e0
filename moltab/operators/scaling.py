"""Scalers, one-hot encoding and the feature-preparation model.

Fitting produces one statistics row (size fixed by the column count) which
is broadcast to the rows; the transform is a single projection inside
whole-stage codegen.  No fitted state depends on row order.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _stats_row(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.agg(*[F.avg(c).alias(f"_mean_{c}") for c in cols],
                  *[F.stddev_samp(c).alias(f"_std_{c}") for c in cols],
                  *[F.min(c).cast("double").alias(f"_min_{c}") for c in cols],
                  *[F.max(c).cast("double").alias(f"_max_{c}") for c in cols])


def _apply(df: DataFrame, stats: DataFrame, cols: Sequence[str], expr) -> DataFrame:
    j = df.crossJoin(F.broadcast(stats))  # one row
    out = [expr(c).alias(c) if c in cols else F.col(c) for c in df.columns]
    return j.select(*out)


def autoscale(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """(x − mean) / sample std; statistics from ``fit_on`` (default: ``df``).

    A constant column (std 0) or a single row (std NULL) gives NULL.
    """
    st = _stats_row(fit_on if fit_on is not None else df, cols)
    return _apply(df, st, cols, lambda c: F.try_divide(F.col(c) - F.col(f"_mean_{c}"),
                                                        F.when(F.col(f"_std_{c}") != 0, F.col(f"_std_{c}"))))


def minmaxscale(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None,
                constant_value: float | None = None) -> DataFrame:
    """(x − min) / (max − min); a constant column gives ``constant_value`` (NULL by default)."""
    st = _stats_row(fit_on if fit_on is not None else df, cols)

    def e(c):
        rng = F.col(f"_max_{c}") - F.col(f"_min_{c}")
        val = F.try_divide(F.col(c) - F.col(f"_min_{c}"), F.when(rng != 0, rng))
        if constant_value is not None:
            val = F.when(rng == 0, F.lit(float(constant_value))).otherwise(val)
        return val
    return _apply(df, st, cols, e)


def log2_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[F.when(F.col(c) > 0, F.log2(c)).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def log10_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[F.when(F.col(c) > 0, F.log10(c)).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


# ------------------------------------------------------------ fitted transformers

@dataclass
class MinMaxModel:
    """Fitted min/max per column (one collected row, like any fitted model's
    coefficients); a constant column maps to 0.0 (zero range → scale 1)."""
    cols: list[str]
    mins: dict[str, float]
    maxs: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        def e(c):
            lo, hi = self.mins[c], self.maxs[c]
            if lo is None or hi is None:
                return F.lit(None).cast("double")
            x = F.col(c).cast("double")
            return (x - F.lit(lo)) if hi == lo else (x - F.lit(lo)) / F.lit(hi - lo)
        return df.select(*[e(c).alias(c) if c in self.cols else F.col(c) for c in df.columns])


def minmax_fit(df: DataFrame, cols: Sequence[str]) -> MinMaxModel:
    row = df.agg(*[F.min(c).cast("double").alias(f"_min_{c}") for c in cols],
                 *[F.max(c).cast("double").alias(f"_max_{c}") for c in cols]).first()
    return MinMaxModel(list(cols), {c: row[f"_min_{c}"] for c in cols},
                       {c: row[f"_max_{c}"] for c in cols})


@dataclass
class OneHotModel:
    """Sorted categories per column; unknown values → all zeros; names ``col_value``."""
    categories: dict[str, list] = field(default_factory=dict)

    def output_names(self) -> list[str]:
        return [f"{c}_{v}" for c, vals in self.categories.items() for v in vals]

    def transform(self, df: DataFrame, keep_input: bool = False) -> DataFrame:
        out = []
        for c in df.columns:
            if c in self.categories:
                if keep_input:
                    out.append(F.col(c))
                for v in self.categories[c]:
                    # a null or unseen value is 0 in every indicator
                    out.append(F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{c}_{v}"))
            else:
                out.append(F.col(c))
        return df.select(*out)


def onehot_fit(df: DataFrame, cols: Sequence[str], max_categories: int = 10000) -> OneHotModel:
    """Distinct categories of each column, sorted.

    The category list defines the output schema, so it has to reach the
    driver; it is computed as one distributed ``groupBy`` and the call fails
    (rather than truncating) if a column has more than ``max_categories``.
    """
    long = (df.select(*[F.col(c).cast("string").alias(c) for c in cols])
            .unpivot([], list(cols), "feature", "value")
            .where(F.col("value").isNotNull()).distinct())
    counts = {r["feature"]: r["n"] for r in long.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}
    too_many = {k: v for k, v in counts.items() if v > max_categories}
    if too_many:
        raise ValueError(f"categorical columns with more than {max_categories} values: {too_many}")
    cats: dict[str, list] = {c: [] for c in cols}
    types = {f.name: f.dataType for f in df.schema.fields}
    for rrow in long.collect():
        v = rrow["value"]
        t = types[rrow["feature"]]
        if isinstance(t, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
            v = int(v)
        elif isinstance(t, (T.DoubleType, T.FloatType)):
            v = float(v)
        elif isinstance(t, T.BooleanType):
            v = v == "true"
        cats[rrow["feature"]].append(v)
    return OneHotModel({c: sorted(vals) for c, vals in cats.items()})


@dataclass
class FeaturePrepModel:
    mode: str
    numeric: list[str]
    categorical: list[str]
    minmax: MinMaxModel | None
    onehot: OneHotModel | None

    @property
    def feature_names(self) -> list[str]:
        names = list(self.numeric) if self.mode != "none" else []
        if self.onehot is not None:
            names += self.onehot.output_names()
        return names

    def transform(self, df: DataFrame, key: Sequence[str] = ()) -> DataFrame:
        d = _bools_to_int(df)
        if self.mode == "none":
            return d
        if self.minmax is not None:
            d = self.minmax.transform(d)
        if self.onehot is not None:
            d = self.onehot.transform(d)
        # category values make names with any characters
        return d.select(*key, *[F.col("`" + n.replace("`", "``") + "`") for n in self.feature_names])


def _bools_to_int(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast("int").alias(f.name) if isinstance(f.dataType, T.BooleanType)
                       else F.col(f.name) for f in df.schema.fields])


class FeaturePrep:
    """``feature_categorization``: modes ``no_categorical``, ``some_categorical``,
    ``categorical`` and ``none``.  Booleans become ints; numeric columns are
    min-max scaled; categorical columns one-hot encoded (sorted categories,
    unknown → zeros).  The same fitted names serve train and test.
    """

    MODES = ("no_categorical", "some_categorical", "categorical", "none")

    def __init__(self, mode: str = "no_categorical", categorical: Sequence[str] | None = None,
                 exclude: Sequence[str] = ()):
        if mode not in self.MODES:
            raise ValueError(f"unknown mode {mode!r}")
        self.mode, self.categorical, self.exclude = mode, list(categorical or []), list(exclude)

    def fit(self, df: DataFrame) -> FeaturePrepModel:
        d = _bools_to_int(df)
        cols = [c for c in d.columns if c not in self.exclude]
        if self.mode == "none":
            return FeaturePrepModel("none", cols, [], None, None)
        if self.mode == "no_categorical":
            cat = []
        elif self.mode == "categorical":
            cat = cols
        else:
            cat = self.categorical or [f.name for f in d.schema.fields if f.name in cols and isinstance(
                f.dataType, (T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.StringType))]
        num = [c for c in cols if c not in cat]
        mm = minmax_fit(d, num) if num else None
        oh = onehot_fit(d, cat) if cat else None
        return FeaturePrepModel(self.mode, num, cat, mm, oh)
