"""ROC and precision-recall curves, their areas and average precision.

The input is reduced to one row per distinct score (positives, negatives);
running totals in descending score order come from
:func:`moltab.operators.ordered.running_sum`, which range-buckets the scores
instead of sorting everything in one task.  Areas need no ``lag``: the
previous point of a curve is the running total minus the current row, so
AUC, PR-AUC and average precision are plain sums over the curve rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moltab.operators.ordered import running_sum


def score_counts(df: DataFrame, known: str, score: str, by: Sequence[str] = (), positive=1) -> DataFrame:
    k = F.col(known)
    return (df.where(k.isNotNull() & F.col(score).isNotNull())
            .groupBy(*by, F.col(score).cast("double").alias("score"))
            .agg(F.count_if(k == F.lit(positive)).alias("pos"),
                 F.count_if(k != F.lit(positive)).alias("neg")))


def _cumulated(df, known, score, by, positive, n_buckets):
    by = list(by)
    counts = score_counts(df, known, score, by, positive).withColumn("one", F.lit(1).cast("long"))
    cum = running_sum(counts, "score", ["pos", "neg", "one"], by=by, descending=True,
                      n_buckets=n_buckets)
    totals = counts.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    if by:
        return cum.join(totals, by, "inner"), totals
    return cum.crossJoin(totals), totals


def roc_curve(df: DataFrame, known: str = "known", score: str = "score", by: Sequence[str] = (),
              positive=1, n_buckets: int | None = None) -> DataFrame:
    """``(by…, ord, threshold, fpr, tpr)``: one point per distinct score, descending,
    plus the ``ord = 0`` anchor (0, 0) with a null threshold."""
    cum, totals = _cumulated(df, known, score, by, positive, n_buckets)
    pts = cum.select(*by, F.col("cum_one").cast("long").alias("ord"), F.col("score").alias("threshold"),
                     F.try_divide(F.col("cum_neg").cast("double"), F.col("N").cast("double")).alias("fpr"),
                     F.try_divide(F.col("cum_pos").cast("double"), F.col("P").cast("double")).alias("tpr"))
    anchor = totals.select(*by, F.lit(0).alias("ord"), F.lit(None).cast("double").alias("threshold"),
                           F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return anchor.unionByName(pts)


def pr_curve(df: DataFrame, known: str = "known", score: str = "score", by: Sequence[str] = (),
             positive=1, n_buckets: int | None = None) -> DataFrame:
    """``(by…, ord, threshold, recall, precision)``: one point per distinct score plus
    the final point (recall 0, precision 1) with a null threshold and ``ord = 0``."""
    cum, totals = _cumulated(df, known, score, by, positive, n_buckets)
    tp, fp = F.col("cum_pos").cast("double"), F.col("cum_neg").cast("double")
    pts = cum.select(*by, F.col("cum_one").cast("long").alias("ord"), F.col("score").alias("threshold"),
                     F.try_divide(tp, F.col("P").cast("double")).alias("recall"),
                     F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)).alias("precision"))
    end = totals.select(*by, F.lit(0).alias("ord"), F.lit(None).cast("double").alias("threshold"),
                        F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision"))
    return end.unionByName(pts)


def curve_summary(df: DataFrame, known: str = "known", score: str = "score", by: Sequence[str] = (),
                  positive=1, n_buckets: int | None = None) -> DataFrame:
    """``(by…, roc_auc, pr_auc, avg_precision)`` by trapezoids / step sums."""
    cum, _ = _cumulated(df, known, score, by, positive, n_buckets)
    P, N = F.col("P").cast("double"), F.col("N").cast("double")
    tp, fp = F.col("cum_pos").cast("double"), F.col("cum_neg").cast("double")
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    tp0, fp0 = tp - pos, fp - neg
    prec = F.try_divide(tp, tp + fp)
    prec0 = F.when(tp0 + fp0 == 0, F.lit(1.0)).otherwise(F.try_divide(tp0, tp0 + fp0))
    roc = F.try_divide(neg * (tp + tp0), 2.0 * N * P)
    pr = F.try_divide(pos * (prec + prec0), 2.0 * P)
    ap = F.try_divide(pos * prec, P)
    return cum.groupBy(*by).agg(F.sum(roc).alias("roc_auc"), F.sum(pr).alias("pr_auc"),
                                F.sum(ap).alias("avg_precision"))


def auc_trapezoid(points: DataFrame, x: str, y: str, by: Sequence[str] = (),
                  order: str | None = None) -> DataFrame:
    """Trapezoid area of an explicit point table ordered by ``order`` (default ``x``).

    Curves are small (one row per distinct threshold) and partitioned by
    ``by``; the ``lag`` window runs per group.  Equals ``numpy.trapz(y, x)``.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(F.col(order or x).asc_nulls_last(), F.col(x), F.col(y))
    seg = points.select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"),
                        F.lag(F.col(x).cast("double")).over(w).alias("_x0"),
                        F.lag(F.col(y).cast("double")).over(w).alias("_y0"))
    area = (F.col("_x") - F.col("_x0")) * (F.col("_y") + F.col("_y0")) / 2.0
    return seg.groupBy(*by).agg(F.coalesce(F.sum(area), F.lit(0.0)).alias("auc"))


def roc_pr_all_classes(df: DataFrame, known: str, prob_cols: dict, by: Sequence[str] = (),
                       n_buckets: int | None = None) -> DataFrame:
    """Curve areas for every class: class ``c`` uses probability column
    ``prob_cols[c]`` and ``positive = c``.  Columns are unpivoted once so all
    classes share one job; ``(by…, class, roc_auc, pr_auc, avg_precision)``."""
    stacked = None
    for cls, col in prob_cols.items():
        part = df.select(*by, F.col(known).alias("_known"), F.lit(cls).alias("class"),
                         F.col(col).cast("double").alias("_score"),
                         (F.col(known) == F.lit(cls)).cast("int").alias("_is_pos"))
        stacked = part if stacked is None else stacked.unionByName(part)
    stacked = stacked.where(F.col("_known").isNotNull())
    return curve_summary(stacked, "_is_pos", "_score", by=list(by) + ["class"], positive=1,
                         n_buckets=n_buckets)
