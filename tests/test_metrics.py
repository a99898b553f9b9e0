import math

import pytest
from pyspark.sql import functions as F

from moltab.operators import curves, metrics, reports
from moltab.operators.ordered import average_rank, row_number, running_sum

PRED = [1, 0, 1, 1, 0, 0, 1, 1]
KNOWN = [1, 0, 1, 0, 0, 1, 1, 0]


def _clf(spark):
    return spark.createDataFrame(list(zip(KNOWN, PRED)), "known int, prediction int")


def test_confusion_dict(spark):
    r = metrics.confusion(_clf(spark)).first()
    assert (r.tn, r.fp, r.fn, r.tp) == (2, 2, 1, 3)


def test_accuracy_percentage(spark):
    assert metrics.accuracy_percentage(_clf(spark)).first().accuracy_pct == pytest.approx(62.5)


def test_rates_from_counts(spark):
    cm = spark.createDataFrame([(40, 10, 5, 50)], "tn long, fp long, fn long, tp long")
    r = metrics.with_rates(cm).first()
    assert r.tpr == pytest.approx(0.909091, abs=1e-6)
    assert r.tnr == pytest.approx(0.8)
    assert r.fpr == pytest.approx(0.2)
    assert r.fnr == pytest.approx(0.090909, abs=1e-6)
    assert r.precision == pytest.approx(0.833333, abs=1e-6)
    assert r.f1 == pytest.approx(0.869565, abs=1e-6)
    assert r.g_mean == pytest.approx(0.852803, abs=1e-6)
    assert r.mcc == pytest.approx(0.715626, abs=1e-6)
    assert r.accuracy == pytest.approx(0.857143, abs=1e-6)


def test_zero_denominators_are_null(spark):
    one_class = spark.createDataFrame([(1, 1), (1, 1)], "known int, prediction int")
    r = metrics.with_rates(metrics.confusion(one_class)).first()
    assert r.tnr is None and r.fpr is None and r.mcc is None
    assert r.tpr == 1.0


def test_nulls_count_nowhere(spark):
    df = spark.createDataFrame([(1, 1), (None, 1), (0, None)], "known int, prediction int")
    r = metrics.confusion(df).first()
    assert (r.tn, r.fp, r.fn, r.tp) == (0, 0, 0, 1)


def test_multilabel_and_balanced_accuracy(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (2, 2)], "known int, prediction int")
    cm = {r.label: r for r in metrics.confusion_multilabel(df).collect()}
    assert (cm[2].tp, cm[2].fn, cm[1].fp) == (1, 1, 1)
    acc = metrics.multiclass_accuracy(metrics.confusion_multilabel(df)).first().accuracy
    assert acc == pytest.approx((1 + 1 + 0.5) / 3)


def test_auc_trapezoid_matches_numpy(spark):
    pts = spark.createDataFrame([(0.0, 0.0), (0.1, 0.2), (0.2, 0.5), (0.3, 0.8)], "x double, y double")
    assert curves.auc_trapezoid(pts, "x", "y").first().auc == pytest.approx(0.11)


def test_roc_and_pr_curves(spark):
    df = spark.createDataFrame(list(zip([0, 1, 0, 1, 0, 1], [.9, .8, .3, .4, .2, .6])), "known int, score double")
    roc = curves.roc_curve(df, "known", "score").orderBy("ord").collect()
    assert len(roc) == 7 and roc[0].fpr == 0 and roc[-1].tpr == 1.0
    s = curves.curve_summary(df, "known", "score").first()
    assert s.roc_auc == pytest.approx(2 / 3, abs=1e-6)  # by pair counting
    pr = curves.pr_curve(df, "known", "score").collect()
    assert len(pr) == 7 and any(p.recall == 0 and p.precision == 1 for p in pr)
    area = curves.auc_trapezoid(curves.roc_curve(df, "known", "score"), "fpr", "tpr", order="ord").first().auc
    assert area == pytest.approx(s.roc_auc)


def test_tied_scores_auc(spark):
    df = spark.createDataFrame([(1, .5), (0, .5), (1, .9), (0, .1)], "known int, score double")
    # pairs: (0.9 vs .5, .1) wins 2, (.5 vs .5) tie 0.5, (.5 vs .1) win 1 -> 3.5/4
    assert curves.curve_summary(df, "known", "score").first().roc_auc == pytest.approx(0.875)


def test_regression_golden(spark):
    df = spark.createDataFrame([(1.0, 1.1), (2.0, 1.9), (3.0, 3.2)], "known double, prediction double")
    r = metrics.metrics_regression(df).first()
    assert r.variance == pytest.approx(0.97667, abs=1e-5)
    assert r.mae == pytest.approx(0.13333, abs=1e-5)
    assert r.mse == pytest.approx(0.02)
    assert r.rmse == pytest.approx(0.14142, abs=1e-5)
    assert r.r2 == pytest.approx(0.97)


def test_ensemble_golden(spark):
    rows = [("p1", i, a, p) for i, (a, p) in enumerate(zip([1.0, 2.0, 3.0, 4.0], [1.1, 1.9, 3.2, 3.8]))]
    rows += [("p2", i, a, p) for i, (a, p) in enumerate(zip([1.0, 2.0, 3.0, 4.0], [1.0, 2.1, 2.9, 4.1]))]
    df = spark.createDataFrame(rows, "model string, row_id int, actual double, predicted double")
    e = reports.ensemble_mean(df)
    got = sorted((r.row_id, round(r.predicted, 6)) for r in e.collect())
    assert [g[1] for g in got] == [1.05, 2.0, 3.05, 3.95]
    m = metrics.metrics_regression(e, "actual", "predicted").first()
    assert m.mae == pytest.approx(0.0375) and m.mse == pytest.approx(0.001875)
    assert m.r2 == pytest.approx(0.9985)


def test_running_sum_partition_invariance(spark):
    df = spark.range(0, 2000).select((F.col("id") % 97).cast("double").alias("v"), F.lit(1).alias("one"),
                                     "id")
    a = running_sum(df.repartition(1), "v", ["one"], tiebreak=["id"]).select("id", "cum_one")
    b = running_sum(df.repartition(17), "v", ["one"], tiebreak=["id"], n_buckets=13).select("id", "cum_one")
    assert sorted(a.collect()) == sorted(b.collect())
    rn = row_number(df, "v", tiebreak=["id"]).agg(F.max("rn").alias("m"), F.count_distinct("rn").alias("d")).first()
    assert rn.m == 2000 and rn.d == 2000


def test_average_rank_ties(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 20.0), (4, 30.0), (5, None)], "id int, v double")
    r = {x.id: x["rank"] for x in average_rank(df, "v").collect()}
    assert r == {1: 1.0, 2: 2.5, 3: 2.5, 4: 4.0, 5: None}


def test_misclassified(spark):
    df = spark.createDataFrame([("mol1", 1, 1), ("mol2", 0, 1), ("mol3", 1, 0), ("mol4", 1, 1), ("mol5", 0, 0)],
                               "name string, known int, prediction int")
    from moltab.operators.columns import misclassified
    assert sorted(r.name for r in misclassified(df).collect()) == ["mol2", "mol3"]


def test_regression_rounded_rmse_from_rounded_mse(spark):
    df = spark.createDataFrame([(1.0, 1.1), (2.0, 1.9), (3.0, 3.2)], "known double, prediction double")
    r = metrics.metrics_regression(df, rounded=True).first()
    assert r.mse == 0.02 and r.rmse == pytest.approx(math.sqrt(0.02))
