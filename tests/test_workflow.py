"""Cross-validated workflows: scalers per fold, reports, failures, restart."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from moltab.operators import models
from moltab.operators.splits import kfold
from moltab.plans import workflow
from moltab.sources.models import load_model


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    out = []
    for i in range(60):
        y = float(i % 2)
        a, b = rng.normal() + 2 * y, rng.normal() * 100
        out.append((i, float(a), float(b), y, 3 * a + 1, 1.0 + i % 3))
    out.append((99, 1.0, 1.0, None, None, 1.0))
    return spark.createDataFrame(out, "id long, a double, b double, y double, t double, w double").checkpoint()


def test_reports_come_from_the_predictions(spark, rows, tmp_path):
    e = workflow.cross_validate(rows, "id", ["a", "b"], "y", {"lr": ("logreg", [{}]), "tree": ("dtree_clf", [{"max_depth": 2}])},
                                n_folds=3, scale="standard")
    p = e.predictions.toPandas()
    assert e.failures.count() == 0 and set(p.columns) == {"model", "fold", "id", "known", "prediction", "prob0", "prob1"}
    fold = {r.id: r.fold for r in kfold(rows.where("y is not null"), "id", 3, seed=42, salt="outer").collect()}
    for name in ("lr", "tree"):
        own = p[p.model == name]
        assert sorted(own.id) == list(range(60)) and all(fold[i] == f for i, f in zip(own.id, own.fold))
    told = {(r.model, r.fold): r for r in e.reports().collect()}
    for (name, f), r in told.items():
        own = p[(p.model == name) & (p.fold == f)]
        assert r.accuracy == pytest.approx((own.known == own.prediction).mean())
        pairs = [(x > z) + 0.5 * (x == z) for x in own.prob1[own.known == 1] for z in own.prob1[own.known == 0]]
        assert r.roc_auc == pytest.approx(np.mean(pairs))
    mean = {(r.model, r.metric): (r["mean"], r["std"]) for r in e.summary().collect()}
    acc = [told["lr", f].accuracy for f in range(3)]
    assert mean["lr", "accuracy"] == (pytest.approx(np.mean(acc)), pytest.approx(np.std(acc)))
    assert e.misclassified().count() == (p.known != p.prediction).sum()
    assert e.classes().where("model = 'lr'").count() == 6


def test_scaler_sees_the_training_part_only(rows):
    for kind in ("minmax", "standard"):
        train, test = rows.where("id < 30"), rows.where("id >= 30")
        s = workflow.fit_scaler(train, ["a", "b"], kind)
        x = np.array([r.a for r in train.collect()])
        lo, size = (x.min(), x.max() - x.min()) if kind == "minmax" else (x.mean(), x.std(ddof=1))
        got = {r.id: r.a for r in s.transform(test).collect()}
        assert all(got[r.id] == pytest.approx((r.a - lo) / size) for r in test.collect())
    assert workflow.fit_scaler(rows, ["a"], None) is None
    with pytest.raises(ValueError):
        workflow.fit_scaler(rows, ["a"], "log")


def test_failures_are_told_and_finished_units_are_read(rows, tmp_path, monkeypatch):
    est = {"good": ("bayes_ridge", [{}]), "bad": ("bayes_ridge", [{"max_iter": 0}])}
    e = workflow.cross_validate(rows, "id", ["a", "b"], "t", est, n_folds=2, folder=str(tmp_path / "run"))
    assert {(r.model, r.fold) for r in e.failures.collect()} == {("bad", 0), ("bad", 1)}
    assert e.predictions.select("model").distinct().count() == 1 and e.regression
    assert e.summary().where("metric = 'r2'").first()["mean"] > 0.99
    calls = []
    real = models.make
    monkeypatch.setattr(models, "make", lambda kind, **p: calls.append(p) or real(kind, **p))
    again = workflow.cross_validate(rows, "id", ["a", "b"], "t", est | {"bad": ("bayes_ridge", [{}])}, n_folds=2,
                                    folder=str(tmp_path / "run"))
    assert len(calls) == 2 and again.failures.count() == 0 and again.predictions.count() == 120
    with pytest.raises(RuntimeError):
        workflow.cross_validate(rows, "id", ["a", "b"], "t", {"bad": est["bad"]}, n_folds=2)
    with pytest.raises(Exception):
        workflow.cross_validate(rows, "id", ["a", "b"], "t", {"bad": est["bad"]}, n_folds=2, error_score="raise")
    with pytest.raises(ValueError):
        workflow.cross_validate(rows, "id", ["a"], "t", {"x": ("logreg", [{}]), "z": ("bayes_ridge", [{}])})


def test_hold_out_writes_models_and_both_sets(rows, tmp_path):
    train, test = rows.where("id < 40 and t is not null"), rows.where("id >= 40 and t is not null")
    est = {"ridge": ("bayes_ridge", [{}]), "lasso": ("lasso", [{"alpha": 0.01}, {"alpha": 0.5}])}
    pred, folder = workflow.hold_out(train, test, "id", ["a", "b"], "t", est, inner_folds=2, folder=str(tmp_path / "out"))
    assert {(r.model, r.set): r["count"] for r in pred.groupBy("model", "set").count().collect()} == \
        {(m, s): n for m in est for s, n in (("train", 40), ("test", 20))}
    scaler, model = load_model(f"{folder}/scaler"), load_model(f"{folder}/models/ridge")
    from moltab.plans.training import assemble
    again = {r.id: r.prediction for r in model.transform(assemble(scaler.transform(test), "id", ["a", "b"], "t")).collect()}
    assert all(again[r.id] == r.prediction for r in pred.where("model = 'ridge' and set = 'test'").collect())


def test_weights_reach_the_fit(rows):
    e = workflow.cross_validate(rows, "id", ["a", "b"], "y", {"lr": ("logreg", [{}])}, n_folds=2, weight_col="w")
    f = workflow.cross_validate(rows, "id", ["a", "b"], "y", {"lr": ("logreg", [{}])}, n_folds=2)
    both = e.predictions.select("id", F.col("prob1").alias("p")).join(f.predictions.select("id", F.col("prob1").alias("q")), "id")
    assert both.where("abs(p - q) > 1e-6").count() > 0
