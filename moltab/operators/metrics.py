"""Confusion-matrix counts and the metrics derived from them.

Counts are built with one grouped aggregation (partial aggregation on the
map side, so the shuffle carries one row per group and partition).  Every
ratio uses ``try_divide``: a zero denominator gives NULL, never an error or
infinity.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNT_COLS = ("tn", "fp", "fn", "tp")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def confusion(df: DataFrame, known: str = "known", pred: str = "prediction",
              by: Sequence[str] = (), positive=1) -> DataFrame:
    """Binary confusion counts ``(by…, tn, fp, fn, tp)``; null known/pred rows count nowhere."""
    k, p = _c(known), _c(pred)
    pos_k, pos_p = k == F.lit(positive), p == F.lit(positive)
    return df.groupBy(*by).agg(
        F.count_if(~pos_k & ~pos_p).alias("tn"),
        F.count_if(~pos_k & pos_p).alias("fp"),
        F.count_if(pos_k & ~pos_p).alias("fn"),
        F.count_if(pos_k & pos_p).alias("tp"),
    )


def confusion_matrix(df: DataFrame, known: str = "known", pred: str = "prediction",
                     labels: Sequence = (0, 1), by: Sequence[str] = ()) -> DataFrame:
    """Long confusion matrix ``(by…, known, predicted, n)`` completed over ``labels``.

    Rows of the matrix are known labels, columns predicted labels, as in the
    reference; absent cells are present with ``n = 0``.
    """
    spark = df.sparkSession
    lab = spark.createDataFrame([(x,) for x in labels], "label " + _lit_type(labels))
    cells = (df.where(F.col(known).isNotNull() & F.col(pred).isNotNull())
             .groupBy(*by, F.col(known).alias("known"), F.col(pred).alias("predicted"))
             .agg(F.count(F.lit(1)).alias("n")))
    if by:
        groups = cells.select(*by).distinct()
        grid = groups.crossJoin(F.broadcast(lab.withColumnRenamed("label", "known"))) \
            .crossJoin(F.broadcast(lab.withColumnRenamed("label", "predicted")))
    else:
        grid = lab.withColumnRenamed("label", "known").crossJoin(lab.withColumnRenamed("label", "predicted"))
    return (grid.join(cells, list(by) + ["known", "predicted"], "left")
            .withColumn("n", F.coalesce("n", F.lit(0)).cast("long")))


def _lit_type(labels) -> str:
    if all(isinstance(x, int) for x in labels):
        return "int"
    if all(isinstance(x, (int, float)) for x in labels):
        return "double"
    return "string"


def confusion_multilabel(df: DataFrame, known: str = "known", pred: str = "prediction",
                         labels: Sequence | None = None, by: Sequence[str] = ()) -> DataFrame:
    """One-vs-rest counts per class: ``(by…, label, tn, fp, fn, tp)``.

    The input is first reduced to ``(by, known, pred) → n`` (at most L² rows
    per group), then crossed with the label list; no row is replicated.
    """
    cells = (df.groupBy(*by, F.col(known).alias("_k"), F.col(pred).alias("_p"))
             .agg(F.count(F.lit(1)).alias("_n")))
    if labels is None:
        lab = (cells.select(F.col("_k").alias("label")).union(cells.select(F.col("_p").alias("label")))
               .where(F.col("label").isNotNull()).distinct())
    else:
        lab = df.sparkSession.createDataFrame([(x,) for x in labels], "label " + _lit_type(labels))
        lab = F.broadcast(lab)
    x = cells.crossJoin(lab)
    k_is, p_is = F.col("_k") == F.col("label"), F.col("_p") == F.col("label")
    n = F.col("_n")

    def s(cond):
        return F.coalesce(F.sum(F.when(cond, n)), F.lit(0)).cast("long")

    return x.groupBy(*by, "label").agg(
        s(~k_is & ~p_is).alias("tn"), s(~k_is & p_is).alias("fp"),
        s(k_is & ~p_is).alias("fn"), s(k_is & p_is).alias("tp"))


# ---------------------------------------------------------------- rates

def _d(name: str) -> Column:
    return F.col(name).cast("double")


def accuracy_expr() -> Column:
    return F.try_divide(_d("tp") + _d("tn"), _d("tp") + _d("tn") + _d("fp") + _d("fn"))


def tpr_expr() -> Column:
    return F.try_divide(_d("tp"), _d("tp") + _d("fn"))


def tnr_expr() -> Column:
    return F.try_divide(_d("tn"), _d("tn") + _d("fp"))


def fpr_expr() -> Column:
    return F.try_divide(_d("fp"), _d("fp") + _d("tn"))


def fnr_expr() -> Column:
    return F.try_divide(_d("fn"), _d("fn") + _d("tp"))


def precision_expr() -> Column:
    return F.try_divide(_d("tp"), _d("tp") + _d("fp"))


recall_expr = tpr_expr


def f_beta_expr(beta: float = 1.0) -> Column:
    p, r = precision_expr(), recall_expr()
    b2 = float(beta) ** 2
    return F.try_divide((1.0 + b2) * p * r, b2 * p + r)


def mcc_expr() -> Column:
    tp, tn, fp, fn = _d("tp"), _d("tn"), _d("fp"), _d("fn")
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return F.try_divide(tp * tn - fp * fn, F.when(den > 0, den))


def g_mean_expr() -> Column:
    return F.sqrt(tpr_expr() * tnr_expr())


def with_rates(counts: DataFrame) -> DataFrame:
    """Add every confusion-derived metric to a ``(…, tn, fp, fn, tp)`` table."""
    return counts.select(
        "*",
        accuracy_expr().alias("accuracy"),
        tpr_expr().alias("tpr"), fpr_expr().alias("fpr"),
        tnr_expr().alias("tnr"), fnr_expr().alias("fnr"),
        g_mean_expr().alias("g_mean"),
        f_beta_expr(0.5).alias("f_half"), f_beta_expr(1.0).alias("f1"), f_beta_expr(2.0).alias("f2"),
        mcc_expr().alias("mcc"),
        precision_expr().alias("precision"), recall_expr().alias("recall"),
        (F.col("tp") + F.col("fn")).alias("support"),
    )


def accuracy_percentage(df: DataFrame, known: str = "known", pred: str = "prediction",
                        by: Sequence[str] = ()) -> DataFrame:
    """100 · matching rows / rows (rows with a null side count as misses)."""
    hit = F.coalesce((F.col(known) == F.col(pred)).cast("double"), F.lit(0.0))
    return df.groupBy(*by).agg(F.try_divide(100.0 * F.sum(hit), F.count(F.lit(1)).cast("double"))
                               .alias("accuracy_pct"))


def multiclass_accuracy(per_class: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy of a confusion matrix with > 2 classes: mean per-class recall."""
    return per_class.groupBy(*by).agg(F.avg(tpr_expr()).alias("accuracy"))


def metrics_binary(df: DataFrame, known: str = "known", pred: str = "prediction",
                   score: str | None = None, by: Sequence[str] = (), positive=1,
                   n_buckets: int | None = None) -> DataFrame:
    """One record per group: counts, rates, F-scores, MCC and (with a score) AUCs."""
    from moltab.operators.curves import curve_summary

    out = with_rates(confusion(df, known, pred, by, positive))
    if score is None:
        return out
    aucs = curve_summary(df, known, score, by=by, positive=positive, n_buckets=n_buckets)
    if by:
        return out.join(aucs, list(by), "left")
    return out.crossJoin(aucs)


def prf_support(df: DataFrame, known: str = "known", pred: str = "prediction",
                labels: Sequence | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Per-class precision, recall, F1 and support (``average=None`` report)."""
    cm = confusion_multilabel(df, known, pred, labels, by)
    return cm.select(*by, "label",
                     precision_expr().alias("precision"), recall_expr().alias("recall"),
                     f_beta_expr(1.0).alias("f1"), (F.col("tp") + F.col("fn")).alias("support"))


def imbalanced_report(df: DataFrame, known: str = "known", pred: str = "prediction",
                      labels: Sequence | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Per class precision, recall, specificity, F1, geometric mean, support, plus
    one ``avg/total`` row per group with support-weighted means."""
    cm = confusion_multilabel(df, known, pred, labels, by)
    per = cm.select(*by, F.col("label").cast("string").alias("label"),
                    precision_expr().alias("precision"), recall_expr().alias("recall"),
                    tnr_expr().alias("specificity"), f_beta_expr(1.0).alias("f1"),
                    g_mean_expr().alias("g_mean"),
                    (F.col("tp") + F.col("fn")).alias("support"))
    sup = F.col("support").cast("double")

    def wavg(c):
        return F.try_divide(F.sum(F.col(c) * sup), F.sum(sup))

    tot = per.groupBy(*by).agg(
        wavg("precision").alias("precision"), wavg("recall").alias("recall"),
        wavg("specificity").alias("specificity"), wavg("f1").alias("f1"),
        wavg("g_mean").alias("g_mean"), F.sum("support").alias("support"))
    tot = tot.select(*by, F.lit("avg/total").alias("label"), "precision", "recall",
                     "specificity", "f1", "g_mean", "support")
    return per.unionByName(tot)


def metrics_regression(df: DataFrame, known: str = "known", pred: str = "prediction",
                       by: Sequence[str] = (), rounded: bool = False) -> DataFrame:
    """Explained variance, MAE, MSE, RMSE and R² in one pass of sums.

    ``rounded=True`` mirrors the hold-out report: every metric rounded to two
    places, and RMSE is the root of the *rounded* MSE.
    """
    y, yh = F.col(known).cast("double"), F.col(pred).cast("double")
    e = y - yh
    base = df.where(y.isNotNull() & yh.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).cast("double").alias("_n"),
        F.sum(e * e).alias("_see"), F.sum(F.abs(e)).alias("_sae"),
        F.var_pop(e).alias("_vare"), F.var_pop(y).alias("_vary"))
    n, vary = F.col("_n"), F.col("_vary")
    ev = 1.0 - F.try_divide(F.col("_vare"), F.when(vary > 0, vary))
    mae = F.col("_sae") / n
    mse = F.col("_see") / n
    r2 = 1.0 - F.try_divide(mse, F.when(vary > 0, vary))
    if rounded:
        from moltab.functions.numeric import round_half_away as rh
        mse_r = rh(mse, 2)
        return base.select(*by, rh(ev, 2).alias("variance"), rh(mae, 2).alias("mae"),
                           mse_r.alias("mse"), F.sqrt(mse_r).alias("rmse"), rh(r2, 2).alias("r2"))
    return base.select(*by, ev.alias("variance"), mae.alias("mae"), mse.alias("mse"),
                       F.sqrt(mse).alias("rmse"), r2.alias("r2"))
