"""Train/test splits and k-fold assignment.

Randomness is ``u01(key, seed)``; positions in that order come from the
distributed :func:`moltab.operators.ordered.row_number`, so fold sizes differ
by at most one exactly as with a shuffled K-fold, without a global sort in
one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moltab.functions.rng import hash32
from moltab.operators.joins import join_hot
from moltab.operators.ordered import row_number
from moltab.session import stored


def _positions(df: DataFrame, key: str, seed, salt: str, by: Sequence[str] = ()) -> DataFrame:
    """Add ``_pos`` (0-based rank by hash(key, seed, salt), key) and ``_n`` (group size)."""
    by = list(by)
    h = df.withColumn("_h", hash32(F.col(key), seed, salt))
    # the numbered rows read a written table: their sizes do not run the input again
    ranked = row_number(h, "_h", tiebreak=[key], by=by, out="_rn")
    n = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    if by:
        # a plain join by few groups would sort all rows of a group in one task
        n = stored(n.withColumn("_size", F.col("_n")), "group-sizes")
        total = n.agg(F.sum("_n").alias("n")).first()["n"] or 0
        j = join_hot(ranked, n, by, "_size", total)
    else:
        j = ranked.crossJoin(F.broadcast(n))
    return j.withColumn("_pos", F.col("_rn") - 1).drop("_rn", "_h")


def split_random(df: DataFrame, key: str, test_frac: float = 0.2, seed=42, out: str = "is_test",
                 by: Sequence[str] = ()) -> DataFrame:
    """First ``ceil(n · test_frac)`` rows in hash order are the test set."""
    p = _positions(df, key, seed, "split", by)
    return p.withColumn(out, F.col("_pos") < F.ceil(F.col("_n") * float(test_frac))).drop("_pos", "_n")


def kfold(df: DataFrame, key: str, n_folds: int = 5, seed=42, out: str = "fold", salt: str = "kfold",
          by: Sequence[str] = ()) -> DataFrame:
    """0-based fold ids; the first ``n % k`` folds hold one extra row (shuffled K-fold)."""
    k = int(n_folds)
    if k < 2:
        raise ValueError("n_folds must be >= 2")
    p = _positions(df, key, seed, salt, by)
    q = F.floor(F.col("_n") / k)
    rem = F.col("_n") - q * k
    big = rem * (q + 1)
    fold = F.when(F.col("_pos") < big, F.floor(F.col("_pos") / (q + 1))) \
        .otherwise(rem + F.floor((F.col("_pos") - big) / q))
    return p.withColumn(out, fold.cast("int")).drop("_pos", "_n")


def split_temporal(df: DataFrame, col: str, test_value=None, out: str = "is_test") -> DataFrame:
    """Rows whose ``col`` equals ``test_value`` (default: the column maximum) are test rows."""
    if test_value is None:
        mx = df.agg(F.max(col).alias("_mx"))
        return df.crossJoin(F.broadcast(mx)).withColumn(out, F.col(col) == F.col("_mx")).drop("_mx")
    return df.withColumn(out, F.col(col) == F.lit(test_value))


def split_by_ids(df: DataFrame, key: str, ids: Iterable | DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train, test): test = rows whose key is in ``ids`` (semi join), train = the rest (anti join).

    Ids come as a DataFrame or, where they are few, as a list; the join strategy is
    Spark's choice by their size.
    """
    if isinstance(ids, DataFrame):
        idf = ids.select(F.col(ids.columns[0]).alias(key)).distinct()
    else:
        spark = df.sparkSession
        vals = list(ids)
        idf = spark.createDataFrame([(v,) for v in vals], f"{key} {df.schema[key].dataType.simpleString()}")
    return df.join(idf, key, "left_anti"), df.join(idf, key, "left_semi")


def tag_origin(train: DataFrame, test: DataFrame, out: str = "set") -> DataFrame:
    return train.withColumn(out, F.lit("train")).unionByName(test.withColumn(out, F.lit("test")))


def class_weights(df: DataFrame, label: str, weights: dict | str = "balanced", out: str = "weight") -> DataFrame:
    """Per-row weight column for ``weightCol``: a literal map, or ``balanced``
    = n / (n_classes · n_c) computed by one grouped count."""
    if weights == "balanced":
        cnt = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
        tot = cnt.agg(F.sum("_nc").alias("_n"), F.count(F.lit(1)).alias("_k"))
        w = cnt.crossJoin(tot).select(label, (F.col("_n") / (F.col("_k") * F.col("_nc"))).alias(out))
        return df.join(w, label, "left")
    m = F.create_map(*[x for kv in weights.items() for x in (F.lit(kv[0]), F.lit(float(kv[1])))])
    return df.withColumn(out, F.coalesce(m[F.col(label)], F.lit(1.0)))
