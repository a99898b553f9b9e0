"""Blocked Gram matrices and the models on them, against plain numpy."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from moltab.operators import gram, models
from moltab.plans import training


def data(seed=0, n=240, p=7, nulls=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) * np.arange(1, p + 1) + 50
    x[:, 3] = x[:, 1] * 0.8 + rng.normal(size=n) * 0.3
    y = 3 + x[:, 0] * 2 - x[:, 2] + rng.normal(size=n)
    if nulls:
        x[rng.random(size=x.shape) < 0.1] = np.nan
    return x, y


def frame(spark, x, y):
    cols = [f"f{i}" for i in range(x.shape[1])]
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in cols) + ", y double").repartition(5), cols


@pytest.mark.parametrize("block", [2, 3, 256])
def test_pairwise_correlations(spark, monkeypatch, block):
    monkeypatch.setattr(gram, "BLOCK", block)
    x, y = data(nulls=True)
    x[:, 5] = 4.25                      # constant
    x[:, 6] = np.nan                    # no value at all
    df, cols = frame(spark, x, y)
    got = {(r.f1, r.f2): r.r for r in gram.corr_pairs(df, cols).collect()}
    assert len(got) == 21
    for i in range(7):
        for j in range(i + 1, 7):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            want = None if j >= 5 else np.corrcoef(x[both, i], x[both, j])[0, 1]
            assert got[f"f{i}", f"f{j}"] == (want if want is None else pytest.approx(want, abs=1e-10))


@pytest.mark.parametrize("held", [1 << 28, 1])
def test_moments_by_fold(spark, monkeypatch, held):
    monkeypatch.setattr(gram, "BLOCK", 3)
    monkeypatch.setattr(gram, "HELD", held)
    x, y = data(nulls=True)
    df, cols = frame(spark, x, y)
    got = gram.moments(df.withColumn("fold", (F.col("id") % 3).cast("int")), [*cols, "y"], fold="fold")
    z, fold = np.column_stack([x, y]), np.arange(len(x)) % 3
    whole = ~np.isnan(z).any(axis=1)
    for f in range(3):
        own = z[whole & (fold == f)]
        assert got[f].n == len(own)
        assert np.allclose(got[f].mean, own.mean(axis=0)) and np.allclose(got[f].cov, np.cov(own.T, bias=True))
    rest = got[0] + got[1]
    own = z[whole & (fold < 2)]
    assert np.allclose(rest.cov, np.cov(own.T, bias=True)) and np.allclose((rest - got[1]).mean, got[0].mean)


def test_many_columns_plan_and_run(spark):
    wide = spark.range(60).select(*[(F.sin(F.col("id") * (i + 1))).alias(f"c{i}") for i in range(600)])
    pairs = gram.corr_pairs(wide, wide.columns)
    assert pairs.count() == 600 * 599 // 2
    x = np.sin(np.arange(60)[:, None] * (np.arange(600) + 1))
    r = {(p.f1, p.f2): p.r for p in pairs.where("f1 in ('c3', 'c299') and f2 in ('c310', 'c599')").collect()}
    for (a, b), v in r.items():
        assert v == pytest.approx(np.corrcoef(x[:, int(a[1:])], x[:, int(b[1:])])[0, 1], abs=1e-9)


def test_lasso_path_meets_the_optimality_conditions(spark):
    x, y = data()
    x[:, 4] = 1.0                        # constant: never enters
    df, cols = frame(spark, x, y)
    m = gram.moments(df, [*cols, "y"])[0]
    alphas = gram.alpha_grid(m, 30)
    path = gram.lasso_path(m, alphas)
    assert not path[0].any() and not path[:, 4].any() and path[-1].any()
    c, n = x - x.mean(axis=0), len(x)
    t = y - y.mean()
    for a, w in zip(alphas, path):
        g = c.T @ (t - c @ w) / n        # subgradient: alpha * sign(w) where w, within alpha elsewhere
        assert np.allclose(g[w != 0], a * np.sign(w[w != 0]), atol=1e-6)
        assert (np.abs(g[w == 0]) <= a + 1e-6).all()
    with pytest.raises(RuntimeError):
        gram.lasso_path(m, alphas[-1:], max_iter=1)


def test_lasso_cv_equals_explicit_folds(spark):
    x, y = data(3)
    df, cols = frame(spark, x, y)
    fold = np.arange(len(x)) % 4
    folds = gram.moments(df.withColumn("fold", (F.col("id") % 4).cast("int")), [*cols, "y"], fold="fold")
    coef, intercept, alpha, table = gram.lasso_cv(folds, n_alphas=12)
    mse = np.zeros((4, 12))
    alphas = sorted({a for a, _, _ in table}, reverse=True)
    for f in range(4):
        tr, _ = frame(spark, x[fold != f], y[fold != f])
        m = gram.moments(tr, [*cols, "y"])[0]
        for k, w in enumerate(gram.lasso_path(m, alphas)):
            pred = y[fold != f].mean() + (x[fold == f] - x[fold != f].mean(axis=0)) @ w
            mse[f, k] = ((pred - y[fold == f]) ** 2).mean()
    assert np.allclose([[v for a, g, v in table if g == f] for f in range(4)], mse, rtol=1e-6)
    assert alpha == alphas[int(mse.mean(axis=0).argmin())]
    assert intercept == pytest.approx(y.mean() - x.mean(axis=0) @ coef)


def test_bayes_ridge_is_a_fixed_point(spark):
    x, y = data(5)
    df, cols = frame(spark, x, y)
    m = gram.moments(df, [*cols, "y"])[0]
    w = gram.bayes_ridge(m, tol=1e-12)
    c, t = x - x.mean(axis=0), y - y.mean()
    # the ridge solution for some ratio of precisions
    ratio = (c.T @ (t - c @ w)) / w
    assert np.allclose(ratio, ratio[0], rtol=1e-4)
    strong = gram.bayes_ridge(m, lambda_1=1e6)
    assert np.abs(strong).sum() < np.abs(w).sum()


def test_models_by_name(spark):
    x, y = data(6)
    df, cols = frame(spark, x, y)
    vec = VectorAssembler(inputCols=cols, outputCol="features").transform(df).withColumn("label", F.col("y"))
    for kind, extra in (("lasso_cv", {"n_alphas": 20}), ("bayes_ridge_cv", {"grid": [{}, {"lambda_1": 10.0}]})):
        model = models.make(kind, key="id", n_folds=5, **extra).fit(vec)
        left = model.transform(vec).agg(F.avg(F.pow(F.col("prediction") - F.col("y"), 2)).alias("mse")).first().mse
        assert left < 1.5


def test_pca_against_svd(spark):
    x, y = data(7)
    df, cols = frame(spark, x, y)
    fitted = gram.pca(df, cols, keep=0.95)
    u, s, v = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    share = np.cumsum(s ** 2) / (s ** 2).sum()
    assert len(fitted.components) == int(np.searchsorted(share, 0.95) + 1)
    assert np.allclose(fitted.variance, (s ** 2 / (len(x) - 1))[:len(fitted.variance)])
    white = gram.pca(df, cols, keep=3, whiten=True)
    pcs = np.array([[r.pc1, r.pc2, r.pc3] for r in white.transform(df).collect()])
    assert np.allclose(np.cov(pcs.T), np.eye(3), atol=1e-8)


def test_variance_inflation(spark):
    x, y = data(8)
    x[:, 5] = 2.0
    x[:, 6] = x[:, 0] + x[:, 2]
    df, cols = frame(spark, x, y)
    got = {r.feature: (r.vif, r.keep) for r in training.vif(df, cols[:6], 10.0).collect()}
    for i in range(5):
        rest = [j for j in range(5) if j != i]
        a = np.column_stack([x[:, rest], np.ones(len(x))])
        res = x[:, i] - a @ np.linalg.lstsq(a, x[:, i], rcond=None)[0]
        want = x[:, i].var() / res.var()
        assert got[f"f{i}"] == (pytest.approx(want, rel=1e-6), want <= 10)
    assert got["f5"] == (None, False)
    assert {r.feature: r.keep for r in training.vif(df, cols, 10.0).collect()}["f6"] is False


def test_permutation_importance_reads_its_input_once(spark):
    """Importances equal tables permuted by hand; the input is not run again for every copy."""
    import hashlib
    n, reps = 300, 2
    rng = np.random.default_rng(6)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 3, n).astype(float)])
    y = (x[:, 0] + 0.2 * rng.normal(size=n) > 0).astype(float)
    seen = spark.sparkContext.accumulator(0)

    def tick(k):
        seen.add(1)
        return k

    class Sign:
        def transform(self, df):
            from pyspark.ml.functions import vector_to_array
            v = vector_to_array("features")
            return df.withColumn("prediction", (v[0] + 0.01 * v[1] > 0).cast("double"))

    df = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))],
                               "id long, a double, b double, y double")
    df = df.withColumn("id", F.udf(tick, "long")("id"))
    got = {r.feature: r for r in training.permutation_importance(Sign(), df, "id", ["a", "b"], "y", reps, 7).collect()}
    h = lambda *p: int(hashlib.md5("|".join(map(str, p)).encode()).hexdigest()[:8], 16)
    place = sorted(range(n), key=lambda i: (h(i, "key"), i))
    score = lambda z: float(((z[:, 0] + 0.01 * z[:, 1] > 0) == y).mean())
    for j, f in enumerate("ab"):
        drops = []
        for r in range(reps):
            z = x.copy()
            z[place, j] = x[sorted(range(n), key=lambda i: (h(i, 7, f, r), i)), j]
            drops.append(score(x) - score(z))
        assert got[f].importance == pytest.approx(np.mean(drops)) and got[f].importance_std == pytest.approx(np.std(drops))
    assert seen.value <= 3 * n
