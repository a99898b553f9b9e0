"""Estimators: MLlib where it exists, DataFrame compositions otherwise.

Every model here is fitted by distributed Spark jobs; the driver holds only
coefficients, trees and the ≤ p×p matrices of the closed-form models.
``fit(df)`` expects a ``features`` vector column and a ``label`` column and
returns an object whose ``transform(df)`` adds ``prediction`` (and ``prob1``
for classifiers).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moltab.operators import gram
from moltab.operators.splits import kfold
from moltab.session import released, stored

FEATURES, LABEL = "features", "label"
#: Kinds whose candidates differ in the number of neighbours.
NEAREST = ("knn_clf", "knn_reg")


def _with_prob1(out: DataFrame) -> DataFrame:
    if "probability" in out.columns:
        out = out.withColumn("prob1", vector_to_array("probability")[1])
    return out


@dataclass
class MLlibModel:
    model: object

    def transform(self, df: DataFrame) -> DataFrame:
        return _with_prob1(self.model.transform(df))


@dataclass
class MLlibSpec:
    """Builds an MLlib estimator from reference-style parameters."""
    kind: str
    params: dict = field(default_factory=dict)

    def fit(self, df: DataFrame, weight_col: str | None = None) -> MLlibModel:
        p = dict(self.params)
        k = self.kind
        extra = {"weightCol": weight_col} if weight_col else {}
        if k == "logreg":
            n = df.count()
            c = float(p.pop("C", 1.0))
            est = C.LogisticRegression(regParam=1.0 / (n * c), elasticNetParam=0.0, standardization=False,
                                       maxIter=int(p.pop("max_iter", 100)), **extra)
        elif k == "dtree_clf":
            est = C.DecisionTreeClassifier(maxDepth=int(p.pop("max_depth", 5)), seed=1, **extra)
        elif k == "dtree_reg":
            est = R.DecisionTreeRegressor(maxDepth=int(p.pop("max_depth", 5)), seed=1, **extra)
        elif k in ("forest_clf", "extratrees"):
            est = C.RandomForestClassifier(numTrees=int(p.pop("n_estimators", 20)),
                                           maxDepth=int(p.pop("max_depth", 5)), seed=1,
                                           bootstrap=(k == "forest_clf") and bool(p.pop("bootstrap", True)),
                                           featureSubsetStrategy=str(p.pop("max_features", "sqrt")), **extra)
        elif k == "forest_reg":
            est = R.RandomForestRegressor(numTrees=int(p.pop("n_estimators", 20)),
                                          maxDepth=int(p.pop("max_depth", 5)), seed=1,
                                          bootstrap=bool(p.pop("bootstrap", True)),
                                          featureSubsetStrategy=str(p.pop("max_features", "auto")), **extra)
        elif k == "lasso":
            est = R.LinearRegression(regParam=float(p.pop("alpha", 0.1)), elasticNetParam=1.0,
                                     standardization=False, **extra)
        elif k == "linear":
            est = R.LinearRegression(regParam=float(p.pop("alpha", 0.0)), elasticNetParam=0.0,
                                     standardization=False, **extra)
        else:
            raise ValueError(f"unknown MLlib model {k!r}")
        return MLlibModel(est.fit(df))


# ------------------------------------------------------------ AdaBoost (SAMME)

@dataclass
class AdaBoostModel:
    stumps: list
    alphas: list
    classes: list

    def transform(self, df: DataFrame) -> DataFrame:
        score = {c: F.lit(0.0) for c in self.classes}
        out = df
        for i, (m, a) in enumerate(zip(self.stumps, self.alphas)):
            p = m.transform(out.select(*out.columns)).select(*out.columns, F.col("prediction").alias(f"_p{i}"))
            out = p
            for c in self.classes:
                score[c] = score[c] + F.when(F.col(f"_p{i}") == float(c), F.lit(a)).otherwise(0.0)
        tot = sum((F.exp(score[c]) for c in self.classes), F.lit(0.0))
        best = F.lit(float(self.classes[0]))
        best_s = score[self.classes[0]]
        for c in self.classes[1:]:
            best = F.when(score[c] > best_s, F.lit(float(c))).otherwise(best)
            best_s = F.greatest(best_s, score[c])
        res = out.withColumn("prediction", best)
        if len(self.classes) == 2:
            res = res.withColumn("prob1", F.exp(score[self.classes[1]]) / tot)
        return res.drop(*[f"_p{i}" for i in range(len(self.stumps))])


@dataclass
class AdaBoostSpec:
    """SAMME boosting of depth-1 trees (Zhu et al. 2009).  Sample weights live in a
    column updated by expressions; lineage is cut with a reliable ``checkpoint``."""
    n_estimators: int = 50
    max_depth: int = 1
    checkpoint_every: int = 5

    def fit(self, df: DataFrame, weight_col: str | None = None) -> AdaBoostModel:
        classes = sorted(r[0] for r in df.select(LABEL).distinct().collect())
        K = len(classes)
        d = df.select(FEATURES, LABEL).withColumn("_w", F.lit(1.0))
        if weight_col:
            d = df.select(FEATURES, LABEL, F.col(weight_col).alias("_w"))
        stumps, alphas = [], []
        for t in range(self.n_estimators):
            m = C.DecisionTreeClassifier(maxDepth=self.max_depth, weightCol="_w", seed=t).fit(d)
            pred = m.transform(d).withColumn("_miss", (F.col("prediction") != F.col(LABEL)).cast("double"))
            agg = pred.agg(F.sum(F.col("_w") * F.col("_miss")).alias("e"), F.sum("_w").alias("w")).first()
            err = agg.e / agg.w if agg.w else 1.0
            if err <= 0:
                stumps.append(m)
                alphas.append(1.0)
                break
            if err >= 1 - 1.0 / K:
                break
            alpha = float(np.log((1 - err) / err) + np.log(K - 1))
            stumps.append(m)
            alphas.append(alpha)
            d = pred.select(FEATURES, LABEL, (F.col("_w") * F.exp(F.lit(alpha) * F.col("_miss")) / F.lit(agg.w))
                            .alias("_w"))
            if (t + 1) % self.checkpoint_every == 0:
                d = d.checkpoint(eager=True)
        return AdaBoostModel(stumps, alphas, classes)


# ------------------------------------------------------------ kNN, RFF, Bayesian ridge

@dataclass
class KnnModel:
    train: DataFrame
    k: int
    regression: bool
    dim: int

    def transform(self, df: DataFrame) -> DataFrame:
        from moltab.operators.neighbors import knn_predict
        with released(df.sparkSession) as keep:
            te = df.withColumn("_kid", F.monotonically_increasing_id()).withColumn("_v", vector_to_array(FEATURES))
            te = stored(te, "knn-asked")  # fixed ids for the join back
            pr = knn_predict(self.train, te.select("_kid", "_v"), "_kid", "_v", LABEL, self.k, self.regression,
                             dim=self.dim)
            # the neighbour search is many stages: materialise its result once
            return keep(stored(te.join(pr, "_kid").drop("_kid", "_v"), "knn-model"))


@dataclass
class KnnSpec:
    """With ``key`` equally near rows are taken in its order."""
    k: int = 5
    regression: bool = False
    key: str | None = None

    def fit(self, df: DataFrame, weight_col: str | None = None) -> KnnModel:
        tr = stored(df.select((F.col(self.key) if self.key else F.monotonically_increasing_id()).alias("_kid"),
                              vector_to_array(FEATURES).alias("_v"), LABEL), "knn-train")  # stable ids and vectors
        dim = len(tr.select("_v").first()[0])
        return KnnModel(tr, self.k, self.regression, dim)


@dataclass
class RffModel:
    w: np.ndarray
    b: np.ndarray
    linear: object

    def transform(self, df: DataFrame) -> DataFrame:
        return self.linear.transform(rff_features(df, self.w, self.b))


def rff_features(df: DataFrame, w: np.ndarray, b: np.ndarray) -> DataFrame:
    """z_k = √(2/D)·cos(w_k·x + b_k) as column expressions (Rahimi & Recht 2007)."""
    from pyspark.ml.functions import array_to_vector
    x = vector_to_array(FEATURES)
    D = w.shape[0]
    zs = []
    for k in range(D):
        # term by term: generated code, where a lambda would be interpreted per component
        dot = F.lit(0.0)
        for j, v in enumerate(w[k]):
            dot = dot + x[j] * F.lit(float(v))
        zs.append(F.sqrt(F.lit(2.0 / D)) * F.cos(dot + F.lit(float(b[k]))))
    return df.withColumn(FEATURES, array_to_vector(F.array(*zs)))


@dataclass
class RffSpec:
    """Kernel models (GP / SVR with RBF) re-aimed: random Fourier features + linear model."""
    n_components: int = 100
    length_scale: float = 1.0
    regression: bool = True
    seed: int = 7
    alpha: float = 0.01

    def fit(self, df: DataFrame, weight_col: str | None = None) -> RffModel:
        p = len(df.select(FEATURES).first()[0])
        rng = np.random.default_rng(self.seed)
        w = rng.normal(scale=1.0 / self.length_scale, size=(self.n_components, p))
        b = rng.uniform(0, 2 * np.pi, size=self.n_components)
        z = rff_features(df, w, b)
        if self.regression:
            lin = R.LinearRegression(regParam=self.alpha, elasticNetParam=0.0, standardization=False).fit(z)
        else:
            lin = C.LogisticRegression(regParam=self.alpha, standardization=False).fit(z)
        return RffModel(w, b, MLlibModel(lin))


@dataclass
class BayesRidgeModel:
    coef: np.ndarray
    intercept: float

    def transform(self, df: DataFrame) -> DataFrame:
        x = vector_to_array(FEATURES)
        wv = F.array(*[F.lit(float(v)) for v in self.coef])
        dot = F.aggregate(F.zip_with(x, wv, lambda a, c: a * c), F.lit(0.0), lambda acc, v: acc + v)
        return df.withColumn("prediction", dot + F.lit(self.intercept))


@dataclass
class BayesRidgeSpec:
    """Evidence-maximised ridge (MacKay 1992) on the Gram matrix of one pass."""
    params: dict = field(default_factory=dict)

    def fit(self, df: DataFrame, weight_col: str | None = None) -> BayesRidgeModel:
        m = gram.vector_moments(df, FEATURES, LABEL)[0]
        coef = gram.bayes_ridge(m, **self.params)
        return BayesRidgeModel(coef, float(m.mean[-1] - m.mean[:-1] @ coef))


@dataclass
class GramCvSpec:
    """Models chosen by cross-validation on Gram matrices: one pass over the rows sums up
    every fold, training sets are the total less a fold."""
    kind: str
    key: str
    n_folds: int = 10
    seed: int = 42
    params: dict = field(default_factory=dict)

    def fit(self, df: DataFrame, weight_col: str | None = None) -> BayesRidgeModel:
        folds = gram.vector_moments(kfold(df, self.key, self.n_folds, seed=self.seed, out="_fold"), FEATURES, LABEL, "_fold")
        if self.kind == "lasso_cv":
            coef, intercept, _, _ = gram.lasso_cv(folds, **self.params)
            return BayesRidgeModel(coef, intercept)
        grid = self.params.get("grid") or [{}]
        mse = gram.cross_validated(folds, lambda m: np.array([gram.bayes_ridge(m, **g) for g in grid]))
        whole = sum(list(folds.values())[1:], list(folds.values())[0])
        coef = gram.bayes_ridge(whole, **grid[int(mse.mean(axis=0).argmin())])
        return BayesRidgeModel(coef, float(whole.mean[-1] - whole.mean[:-1] @ coef))


def make(kind: str, **params):
    """Registry: reference model names → specs."""
    if kind == "adaboost":
        return AdaBoostSpec(n_estimators=int(params.get("n_estimators", 50)))
    if kind in NEAREST:
        return KnnSpec(k=int(params.get("n_neighbors", 5)), regression=(kind == "knn_reg"), key=params.get("key"))
    if kind in ("kernel_reg", "kernel_clf"):
        return RffSpec(n_components=int(params.get("n_components", 100)),
                       length_scale=float(params.get("length_scale", 1.0)), regression=(kind == "kernel_reg"),
                       alpha=float(params.get("alpha", 0.01)))
    if kind == "bayes_ridge":
        return BayesRidgeSpec(dict(params))
    if kind in ("lasso_cv", "bayes_ridge_cv"):
        return GramCvSpec(kind, params.pop("key"), int(params.pop("n_folds", 10)), int(params.pop("seed", 42)), params)
    return MLlibSpec(kind, dict(params))


CLASSIFIERS = {"logreg", "dtree_clf", "forest_clf", "extratrees", "adaboost", "knn_clf", "kernel_clf"}
