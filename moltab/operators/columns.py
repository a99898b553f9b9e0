"""Column clean-up and selection.

Column statistics come from one pass over the *long* form
``(feature, value)`` grouped by feature: the shuffle carries one partial row
per feature and partition whatever the row count, and tables with thousands
of descriptor columns need no thousand-expression projection.  Decisions are
returned as small tables ``(feature, …, keep)``; only the list of kept names
(bounded by the column count, not by the data) reaches the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.DecimalType)


# ------------------------------------------------------------ names (schema level)

def normalize_names(df: DataFrame) -> DataFrame:
    """Trimmed lower-case names in which every blank is an underscore."""
    blanks = str.maketrans({" ": "_"})
    return df.toDF(*(name.strip().lower().translate(blanks) for name in df.columns))


def directory_name(col: str | Column) -> Column:
    """Any whitespace run → ``_`` after trimming (``directory_names``)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(F.trim(c), r"\s+", "_")


def directory_name_text(name: str) -> str:
    return re.sub(r"\s+", "_", name.strip())


def strip_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def prefix_names(df: DataFrame, prefix: str, keep: Iterable[str] = ()) -> DataFrame:
    keep = set(keep)
    return df.select(*[F.col(c).alias(c if c in keep else prefix + c) for c in df.columns])


def suffix_overlap(left: DataFrame, right: DataFrame, on: Sequence[str], lsuffix: str, rsuffix: str):
    """Rename columns present on both sides (except the join keys)."""
    both = (set(left.columns) & set(right.columns)) - set(on)
    l2 = left.select(*[F.col(c).alias(c + lsuffix if c in both else c) for c in left.columns])
    r2 = right.select(*[F.col(c).alias(c + rsuffix if c in both else c) for c in right.columns])
    return l2, r2


def ordered_distinct(names: Iterable[str]) -> list[str]:
    seen, out = set(), []
    for n in names:
        if n not in seen:
            seen.add(n)
            out.append(n)
    return out


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC) and f.name not in ex]


def infer_categorical(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Integer-typed columns are categorical (the reference's int64 rule)."""
    ex = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.IntegerType, T.LongType, T.ShortType, T.ByteType))
            and f.name not in ex]


# ------------------------------------------------------------ labels and casts

def label_two_class(df: DataFrame, col: str, bound: float = 4.0, on_null=None,
                    out: str = "classes") -> DataFrame:
    """``x < bound → 0``, ``x >= bound → 1``; a null target gets ``on_null``."""
    x = F.col(col)
    lab = F.when(x < bound, 0).when(x >= bound, 1)
    if on_null is not None:
        lab = lab.when(x.isNull(), int(on_null))
    return df.withColumn(out, lab.cast("int"))


def label_sentinel(df: DataFrame, col: str, out: str = "classes") -> DataFrame:
    """Missing activity (null or the text ``'N'``) or a value > 0 → 0, else 1."""
    t = F.col(col).cast("string").try_cast("double")
    return df.withColumn(out, F.when(t.isNull() | (t > 0), 0).otherwise(1).cast("int"))


def bool_to_int(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast("int").alias(f.name)
                       if isinstance(f.dataType, T.BooleanType) else F.col(f.name)
                       for f in df.schema.fields])


def coerce_numeric(df: DataFrame, col: str, drop: bool = True) -> DataFrame:
    """``try_cast`` to double; with ``drop`` rows that do not parse are removed."""
    out = df.withColumn(col, F.col(col).cast("string").try_cast("double"))
    return out.where(F.col(col).isNotNull()) if drop else out


def nan_to_null(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    cols = set(cols if cols is not None else [f.name for f in df.schema.fields
                                              if isinstance(f.dataType, (T.DoubleType, T.FloatType))])
    return df.select(*[F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


# ------------------------------------------------------------ statistics

def to_long(df: DataFrame, key: str | Sequence[str], cols: Sequence[str],
            feature: str = "feature", value: str = "value") -> DataFrame:
    """Unpivot ``cols`` to ``(key…, feature, value DOUBLE)``; nulls are kept."""
    keys = [key] if isinstance(key, str) else list(key)
    d = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols])
    return d.unpivot(keys, list(cols), feature, value)


def feature_stats(df: DataFrame, cols: Sequence[str], key: str | None = None) -> DataFrame:
    """One row per feature: ``n, n_null, mean, std, std_pop, min, max, n_nonzero,
    all_nonzero, is_constant`` (constant = one distinct non-null value)."""
    d = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    long = d.unpivot([], list(cols), "feature", "value")
    v = F.col("value")
    return long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(v.isNull()).alias("n_null"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.stddev_pop(v).alias("std_pop"),
        F.min(v).alias("min"), F.max(v).alias("max"),
        F.count_if(v != 0).alias("n_nonzero"),
    ).withColumn("all_nonzero", F.col("n_nonzero") == F.col("n")) \
     .withColumn("is_constant", F.col("min") == F.col("max"))


def _kept(decisions: DataFrame, order: Sequence[str]) -> list[str]:
    keep = {r["feature"] for r in decisions.where("keep").select("feature").collect()}
    return [c for c in order if c in keep]


def constant_cols(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(feature, is_constant, keep)``: constant columns (one distinct non-null value)
    are not kept."""
    constant = F.coalesce(F.col("is_constant"), F.lit(False))
    return feature_stats(df, cols).select("feature", constant.alias("is_constant"),
                                          (~constant).alias("keep"))


def skip_sparse_decisions(df: DataFrame, cols: Sequence[str], max_null_frac: float = 0.7) -> DataFrame:
    st = feature_stats(df, cols)
    frac = F.try_divide(F.col("n_null").cast("double"), F.col("n").cast("double"))
    return st.select("feature", frac.alias("null_frac"), (frac < max_null_frac).alias("keep"))


def low_std_decisions(df: DataFrame, cols: Sequence[str], min_std: float = 0.5) -> DataFrame:
    st = feature_stats(df, cols)
    return st.select("feature", "std", F.coalesce(F.col("std") >= min_std, F.lit(False)).alias("keep"))


def zero_col_decisions(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    st = feature_stats(df, cols)
    return st.select("feature", "n_nonzero", (F.col("n_nonzero") > 0).alias("keep"))


def null_col_decisions(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    st = feature_stats(df, cols)
    return st.select("feature", "n_null", (F.col("n_null") == 0).alias("keep"))


def all_nonzero_decisions(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    st = feature_stats(df, cols)
    return st.select("feature", "n_nonzero", F.col("all_nonzero").alias("keep"))


def apply_decisions(df: DataFrame, decisions: DataFrame, cols: Sequence[str],
                    always: Sequence[str] = ()) -> DataFrame:
    """Project ``always`` columns plus the features whose decision row says keep."""
    return df.select(*always, *_kept(decisions, cols))


def select_columns(df: DataFrame, cols: Sequence[str], always: Sequence[str] = (), min_std=None,
                   drop_zero=True, drop_constant=True, max_null_frac=None) -> DataFrame:
    """All column filters from a single statistics pass."""
    st = feature_stats(df, cols)
    keep = F.lit(True)
    if min_std is not None:
        keep = keep & F.coalesce(F.col("std") >= min_std, F.lit(False))
    if drop_zero:
        keep = keep & (F.col("n_nonzero") > 0)
    if drop_constant:
        keep = keep & ~F.coalesce(F.col("is_constant"), F.lit(True))
    if max_null_frac is not None:
        keep = keep & (F.col("n_null") / F.col("n") < max_null_frac)
    return apply_decisions(df, st.select("feature", keep.alias("keep")), cols, always)


def drop_null_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(subset) if subset else None)


def drop_rows_min_nonnull(df: DataFrame, thresh: int, subset: Sequence[str] | None = None) -> DataFrame:
    """Keep rows with at least ``thresh`` non-null cells (``dropna(thresh=k)``)."""
    return df.na.drop(thresh=int(thresh), subset=list(subset) if subset else None)


def fill_mean(df: DataFrame, cols: Sequence[str], max_null_frac: float = 0.7) -> DataFrame:
    """Replace nulls by the column mean when the null share is below ``max_null_frac``.

    Means come from one aggregate row (size fixed by the column count), joined
    by broadcast.
    """
    stats = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols],
                   *[F.avg(F.col(c).isNull().cast("double")).alias(f"_z_{c}") for c in cols])
    j = df.crossJoin(F.broadcast(stats))
    out = []
    for c in df.columns:
        if c in cols:
            out.append(F.when(F.col(f"_z_{c}") < max_null_frac, F.coalesce(F.col(c), F.col(f"_m_{c}")))
                       .otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def align_test_cols(train_cols: Sequence[str], test: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """Keep test columns that exist in train, in train order."""
    have = set(test.columns)
    return test.select(*key, *[c for c in train_cols if c in have and c not in key])


def fill_missing_cols(train_cols: Sequence[str], test: DataFrame, key: Sequence[str] = (),
                      fill=0) -> DataFrame:
    """Add train-only columns to the test table filled with ``fill``; train order."""
    have = set(test.columns)
    return test.select(*key, *[F.col(c) if c in have else F.lit(fill).alias(c)
                               for c in train_cols if c not in key])


def misclassified(df: DataFrame, known: str = "known", pred: str = "prediction") -> DataFrame:
    return df.where(~F.col(known).eqNullSafe(F.col(pred)))


def coverage_check(all_ids: DataFrame, tested: DataFrame, key: str) -> DataFrame:
    """Ids never tested (left anti join); an empty result means full coverage."""
    return all_ids.select(key).join(tested.select(key), key, "left_anti")
