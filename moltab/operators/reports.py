"""Per-model reports, fold summaries, ensembles, set overlaps (§2.4, §2.7, §2.12)."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moltab.functions.numeric import round_half_away
from moltab.operators import metrics


def all_reg_report(preds: DataFrame, known: str = "known", pred: str = "prediction",
                   by: Sequence[str] = ("model",)) -> DataFrame:
    """Five regression metrics per model in one grouped job."""
    return metrics.metrics_regression(preds, known, pred, by=list(by))


def all_class_report(preds: DataFrame, known: str = "known", pred: str = "prediction",
                     score: str | None = "prob1", by: Sequence[str] = ("model",),
                     synthetic: str | None = None, prob_cols: dict | None = None) -> DataFrame:
    """Per model and class: tpr, fpr, tnr, fnr, f_half, f1, f2, mcc, precision,
    recall (+ roc_auc, pr_auc of the class's own probability), rounded to 2.
    ``score`` is the probability of class 1, class 0 has the rest; more classes are
    given as ``prob_cols`` (class to column).  With a ``synthetic`` flag column both
    passes ("all" rows and "real" rows only) run as one job through a grouping
    column instead of twice."""
    by = list(by)
    d = preds.withColumn("subset", F.lit("all"))
    if synthetic:
        d = d.unionByName(preds.where(~F.col(synthetic)).withColumn("subset", F.lit("real")))
    cm = metrics.confusion_multilabel(d, known, pred, by=by + ["subset"])
    rates = metrics.with_rates(cm)
    cols = ["tpr", "fpr", "tnr", "fnr", "f_half", "f1", "f2", "mcc", "precision", "recall"]
    out = rates.select(*by, "subset", F.col("label").alias("class"), *[round_half_away(c, 2).alias(c) for c in cols])
    if score is not None and prob_cols is None:
        d = d.withColumn("_prob0", 1 - F.col(score).cast("double"))
        prob_cols = {1: score, 0: "_prob0"}
    if prob_cols:
        from moltab.operators.curves import roc_pr_all_classes
        au = roc_pr_all_classes(d, known, prob_cols, by=by + ["subset"])
        out = out.join(au.select(*by, "subset", "class", round_half_away("roc_auc", 2).alias("roc_auc"),
                                 round_half_away("pr_auc", 2).alias("pr_auc")),
                       by + ["subset", "class"], "left")
    return out


def fold_mean_std(scores: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Mean and population std over folds."""
    return scores.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def ensemble_mean(preds: DataFrame, key: str = "row_id", model: str = "model",
                  actual: str = "actual", pred: str = "predicted",
                  first_model: str | None = None) -> DataFrame:
    """Mean prediction per row over models; the actual value comes from
    ``first_model`` (default: the smallest model name), as the reference takes
    it from the first file.  ``(key, actual, predicted)``"""
    order = F.col(model) if first_model is None else (F.col(model) != F.lit(first_model)).cast("int")
    g = preds.groupBy(key).agg(
        F.min_by(F.col(actual), F.struct(order, F.col(model))).alias("actual"),
        F.avg(pred).alias("predicted"))
    return g


def set_overlaps(members: DataFrame, set_col: str, key: str, max_order: int = 3) -> DataFrame:
    """Venn region sizes: for every combination of 2 (and 3) named sets, the size of
    each non-empty intersection.  ``(sets, n)`` where ``sets`` is the sorted
    ``&``-joined list of set names.  Members are grouped once per key
    (``collect_set`` of set names — bounded by the number of sets), then each key
    contributes to every combination of its sets."""
    per_key = members.groupBy(key).agg(F.array_sort(F.collect_set(set_col)).alias("_sets"))
    combos = []
    for k in range(2, max_order + 1):
        combos.append(_combinations_expr("_sets", k))
    ex = per_key.select(key, F.explode(F.flatten(F.array(*combos))).alias("sets"))
    return ex.groupBy("sets").agg(F.count(F.lit(1)).alias("n"))


def _combinations_expr(arr: str, k: int):
    """All k-combinations of a (small) sorted array as '&'-joined strings."""
    a = F.col(arr)
    n = F.size(a)
    if k == 2:
        return F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.transform(
            F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda j: j > i),
            lambda j: F.concat_ws("&", F.element_at(a, i), F.element_at(a, j)))))
    if k == 3:
        seq = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
        return F.flatten(F.flatten(F.transform(seq, lambda i: F.transform(
            F.filter(seq, lambda j: j > i), lambda j: F.transform(
                F.filter(seq, lambda m: m > j),
                lambda m: F.concat_ws("&", F.element_at(a, i), F.element_at(a, j), F.element_at(a, m)))))))
    raise ValueError("max_order up to 3")


def intersect_sets(frames: Sequence[DataFrame], key: str) -> DataFrame:
    out = frames[0].select(key)
    for f in frames[1:]:
        out = out.intersect(f.select(key))
    return out


def topk_abs(df: DataFrame, value: str, n: int, tiebreak: str = "feature") -> DataFrame:
    """Top ``n`` by |value| desc, ties by ``tiebreak`` (TakeOrdered: no full sort)."""
    return df.orderBy(F.abs(F.col(value)).desc(), F.col(tiebreak).asc()).limit(n)


def argmax_abs(df: DataFrame, group: str, item: str, value: str) -> DataFrame:
    """Per group the item with the largest |value| (ties: smallest item)."""
    return df.groupBy(group).agg(
        F.min_by(F.col(item), F.struct(-F.abs(F.col(value)), F.col(item))).alias(item),
        F.max(F.abs(F.col(value))).alias("abs_value"))


def rank_candidates(grid: DataFrame, score: str = "mean_score", by: Sequence[str] = ("model", "metric"),
                    out: str = "rank") -> DataFrame:
    """Min-rank by mean score descending (ties share the rank)."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc_nulls_last())
    return grid.withColumn(out, F.rank().over(w))


def keep_first(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """First row per key by ``order`` (aggregation with ``min_by``, no window sort)."""
    rest = [c for c in df.columns if c != key]
    g = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*[F.col(c) for c in order])).alias("_r"))
    return g.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def cum_variance(explained: Sequence[float] | DataFrame, cut: float = 0.95) -> DataFrame:
    """Cumulative explained variance per component and the first k reaching ``cut``.
    Input: ``(k, ratio)`` rows (one per component: bounded by the column count)."""
    w = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = explained.withColumn("cum", F.sum("ratio").over(w))
    return d.withColumn("reached", F.col("cum") >= F.lit(cut))
