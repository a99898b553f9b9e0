"""Feature importance and explanations.

Importances are small tables ``(feature, importance)``; model coefficients
are the only thing read from a fitted model on the driver.  Row-level
explanations (Shapley values of linear models, bit legends) are column
expressions or per-row joins with a table bounded by the feature count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def complete_bits(importance: DataFrame, n_bits: int, bit: str = "bit",
                  value: str = "importance") -> DataFrame:
    """Dense completion: every bit 0..n_bits−1, absent ones with importance 0."""
    spark = importance.sparkSession
    allb = spark.range(n_bits).select(F.col("id").cast("int").alias(bit))
    imp = importance.select(F.col(bit).cast("int").alias(bit), F.col(value).cast("double").alias(value))
    return allb.join(imp, bit, "left").select(bit, F.coalesce(F.col(value), F.lit(0.0)).alias(value))


def row_bit_legend(fps: DataFrame, key: str, bits: str, importance: DataFrame,
                   bit: str = "bit", value: str = "importance") -> DataFrame:
    """Per row: its on-bits that carry importance, by importance desc (then bit),
    as the legend text ``"bit (0.1234), …"``.  The importance table has at most
    one row per bit; Spark broadcasts it if its size allows."""
    ex = fps.select(key, F.explode(bits).alias(bit))
    j = ex.join(importance.select(bit, value), bit)
    g = j.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col(value)).alias("_neg"), F.col(bit),
                                                               F.col(value)))).alias("_l"))
    text = F.transform("_l", lambda s: F.format_string("%d (%.4f)", s[bit], s[value]))
    return g.select(key, F.array_join(text, ", ").alias("legend"))


def coef_importance(model, feature_names: Sequence[str]) -> DataFrame:
    """``(feature, importance, importance_abs)`` from tree importances or linear
    coefficients of a fitted MLlib model (driver-side vector of length p)."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    stage = model.stages[-1] if hasattr(model, "stages") else model
    if hasattr(stage, "featureImportances"):
        vals = stage.featureImportances.toArray().tolist()
    elif hasattr(stage, "coefficients"):
        vals = stage.coefficients.toArray().tolist()
    elif hasattr(stage, "coefficientMatrix"):
        vals = stage.coefficientMatrix.toArray()[-1].tolist()
    else:
        raise TypeError(f"model {type(stage).__name__} has neither importances nor coefficients")
    rows = [(n, float(v), abs(float(v))) for n, v in zip(feature_names, vals)]
    return spark.createDataFrame(rows, "feature string, importance double, importance_abs double")


def bit_importance(importance: DataFrame, n_bits: int, prefix: str = "fp_") -> DataFrame:
    """Keep fingerprint features (``fp_k``), drop the rest, complete 0..n_bits−1 with 0."""
    bits = importance.where(F.col("feature").rlike(f"^{prefix}[0-9]+$")).select(
        F.regexp_extract("feature", f"^{prefix}([0-9]+)$", 1).cast("int").alias("bit"), "importance")
    return complete_bits(bits, n_bits)


def shap_linear(df: DataFrame, key: str, features: Sequence[str], coefficients: dict[str, float],
                background: DataFrame | None = None) -> DataFrame:
    """Exact Shapley values of a linear model with independent features:
    φ_ij = w_j · (x_ij − mean_j), means over ``background`` (default: ``df``).
    Long output ``(key, feature, phi)``; means are one broadcast row."""
    bg = background if background is not None else df
    means = bg.agg(*[F.avg(c).alias(f"_m_{c}") for c in features])
    j = df.crossJoin(F.broadcast(means))
    stack = ", ".join(f"'{c}', CAST({float(coefficients[c])!r} * (`{c}` - `_m_{c}`) AS DOUBLE)" for c in features)
    return j.selectExpr(key, f"stack({len(features)}, {stack}) AS (feature, phi)")


def mean_abs_shap(phi: DataFrame) -> DataFrame:
    return phi.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs_phi"))


def shap_sampled(model, df: DataFrame, key: str, feature_cols: Sequence[str], background: DataFrame,
                 n_samples: int = 10, seed: int = 0, output: str = "prob1") -> DataFrame:
    """Permutation-sampling Shapley values (Štrumbelj & Kononenko 2014).

    For row r and sample s: a random feature order and a background row, both
    from hashes of (r, s); hybrids h_t take the first t features of the order
    from r and the rest from the background row (t = 0..p).  All hybrids of all
    rows are scored in one ``model.transform``; the marginal of the feature at
    order position t is f(h_t) − f(h_{t−1}); φ is its mean over samples.
    ``(key, feature, phi)``.
    """
    from pyspark.ml.functions import array_to_vector

    from moltab.functions.rng import hash32
    from moltab.operators.ordered import row_number

    p = len(feature_cols)
    spark = df.sparkSession
    bg = background.select(F.array(*[F.col(c).cast("double") for c in feature_cols]).alias("_b"))
    bg = row_number(bg.withColumn("_hb", hash32(F.col("_b").cast("string"), seed, "bg")), "_hb",
                    out="_bpos").drop("_hb")
    nbg = bg.agg(F.count(F.lit(1)).alias("_nbg"))
    ss = spark.range(n_samples).select(F.col("id").cast("int").alias("s"))
    rows = df.select(key, F.array(*[F.col(c).cast("double") for c in feature_cols]).alias("_x")) \
        .crossJoin(F.broadcast(ss)).crossJoin(F.broadcast(nbg))  # samples: a parameter; nbg: one row
    rows = rows.withColumn("_bpos", (hash32(F.col(key), seed, F.col("s"), "row") % F.col("_nbg")) + 1)
    rows = rows.join(bg, "_bpos")
    # random order of feature indices: sort (hash, j)
    order = F.transform(F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(p - 1)),
                                                 lambda j: F.struct(hash32(F.col(key), seed, F.col("s"), j).alias("h"),
                                                                    j.alias("j")))), lambda e: e["j"])
    rows = rows.withColumn("_ord", order)
    hyb = rows.select(key, "s", "_ord", "_x", "_b", F.explode(F.sequence(F.lit(0), F.lit(p))).alias("t"))
    # position of feature j in the order, then take x_j if position < t
    vec = F.transform(F.sequence(F.lit(0), F.lit(p - 1)),
                      lambda j: F.when(F.array_position(F.col("_ord"), j) <= F.col("t"),
                                       F.element_at(F.col("_x"), j + 1)).otherwise(F.element_at(F.col("_b"), j + 1)))
    hyb = hyb.withColumn("features", array_to_vector(vec))
    scored = model.transform(hyb).select(key, "s", "t", "_ord", F.col(output).cast("double").alias("_f"))
    from pyspark.sql import Window
    w = Window.partitionBy(key, "s").orderBy("t")  # p + 1 rows per (row, sample)
    marg = scored.withColumn("_prev", F.lag("_f").over(w)).where(F.col("t") >= 1) \
        .select(key, F.element_at(F.col("_ord"), F.col("t")).alias("_j"), (F.col("_f") - F.col("_prev")).alias("_d"))
    names = F.array(*[F.lit(c) for c in feature_cols])
    return marg.groupBy(key, "_j").agg(F.avg("_d").alias("phi")) \
        .select(key, F.element_at(names, F.col("_j") + 1).alias("feature"), "phi")
