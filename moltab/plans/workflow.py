"""Cross-validated workflows with a scaler fitted per fold, reports per fold and restart.

Every (model, fold) is a unit of its own: scaler and grid search see the training part
only, its predictions are written as one folder, and a unit that failed is reported
instead of ending the run (``error_score``).  Called again with the same folder, finished
units are read, not fitted: folds depend on keys and seed alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moltab.operators import metrics, models
from moltab.operators.columns import misclassified
from moltab.operators.reports import fold_mean_std
from moltab.operators.scaling import minmax_fit
from moltab.operators.splits import kfold
from moltab.plans.training import assemble, split_test
from moltab.session import scratch_path
from moltab.sources.models import _exists, save_model

SCALERS = (None, "minmax", "standard")
#: Numbers of a report that are averaged over folds.
CLF_NUMBERS = ("accuracy", "precision", "recall", "tnr", "f1", "mcc", "g_mean", "roc_auc", "pr_auc")
REG_NUMBERS = ("mae", "mse", "rmse", "r2")


@dataclass(frozen=True)
class StandardModel:
    """Mean and sample deviation per column; a constant column maps to 0."""
    cols: list[str]
    means: dict[str, float]
    deviations: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        scaled = {c: (F.col(c).cast("double") - self.means[c]) / (self.deviations[c] or 1.0) for c in self.cols}
        return df.select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns])


def fit_scaler(df: DataFrame, cols: Sequence[str], kind: str | None):
    """A fitted scaler (``transform``), or None."""
    if kind not in SCALERS:
        raise ValueError(f"unknown scaler {kind!r}; use one of {SCALERS}")
    if kind is None:
        return None
    if kind == "minmax":
        return minmax_fit(df, list(cols))
    r = df.agg(*[f(c).alias(f"{n}_{i}") for i, c in enumerate(cols) for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    return StandardModel(list(cols), {c: r[f"m_{i}"] for i, c in enumerate(cols)}, {c: r[f"s_{i}"] for i, c in enumerate(cols)})


@dataclass(frozen=True)
class Evaluation:
    """Predictions ``(model, fold, key, known, prediction[, prob0, prob1])`` in ``folder``
    and the units that failed ``(model, fold, error)``."""
    folder: str
    predictions: DataFrame
    failures: DataFrame
    key: str
    regression: bool

    def reports(self) -> DataFrame:
        """One row per model and fold."""
        p = self.predictions
        if self.regression:
            return metrics.metrics_regression(p, "known", "prediction", by=["model", "fold"])
        return metrics.metrics_binary(p, "known", "prediction", score="prob1", by=["model", "fold"], positive=1.0)

    def classes(self) -> DataFrame:
        """Precision, recall, F1 and support of every class per model and fold."""
        return metrics.prf_support(self.predictions, "known", "prediction", by=["model", "fold"])

    def summary(self) -> DataFrame:
        """``model, metric, mean, std`` over the folds that have the number."""
        r = self.reports()
        names = [c for c in (REG_NUMBERS if self.regression else CLF_NUMBERS) if c in r.columns]
        long = r.select("model", "fold", *[F.col(c).cast("double").alias(c) for c in names]) \
            .unpivot(["model", "fold"], names, "metric", "value")
        return fold_mean_std(long.where(F.col("value").isNotNull()), "value", ["model", "metric"])

    def misclassified(self) -> DataFrame:
        return misclassified(self.predictions)


def _unit(train: DataFrame, test: DataFrame, key: str, cols: list[str], label: str, kind: str, grid: Sequence[dict],
          scale: str | None, inner_folds: int, seed: int, weight_col: str | None):
    """Predictions of the held-out rows, the fitted scaler and model."""
    scaler = fit_scaler(train, cols, scale)
    if scaler:
        train, test = scaler.transform(train), scaler.transform(test)
    tr, te = assemble(train, key, cols, label), assemble(test, key, cols, label)
    if weight_col:
        tr = tr.join(train.select(key, weight_col), key)
    tr = tr.checkpoint(eager=True)       # many fits read it
    if len(grid) == 1:                   # nothing to choose
        model = models.make(kind, **grid[0]).fit(tr, weight_col)
        pred = model.transform(te)
        cols_ = [key, F.col(models.LABEL).alias("known"), "prediction"]
        if "prob1" in pred.columns:
            cols_ += [(1 - F.col("prob1")).alias("prob0"), "prob1"]
        return pred.select(*cols_), scaler, model
    pred, _, model = split_test(tr, te, key, kind, grid, inner_folds, seed=seed, weight_col=weight_col, final_weights_only=True)
    return pred, scaler, model


def cross_validate(df: DataFrame, key: str, feature_cols: Sequence[str], label: str,
                   estimators: dict[str, tuple[str, Sequence[dict]]], n_folds: int = 10, inner_folds: int = 5,
                   scale: str | None = "minmax", seed: int = 42, weight_col: str | None = None,
                   folder: str | None = None, error_score: str = "nan") -> Evaluation:
    """Nested cross-validation of several estimators (``name -> (kind, grid)``).

    Rows with a null label take no part.  ``error_score="raise"`` ends at the first failure.
    Classifiers and regressors do not mix in one call.
    """
    if error_score not in ("nan", "raise"):
        raise ValueError("error_score must be 'nan' or 'raise'")
    if not estimators:
        raise ValueError("no estimator given")
    sorts = {kind in models.CLASSIFIERS for kind, _ in estimators.values()}
    if len(sorts) > 1:
        raise ValueError("classifiers and regressors in one call")
    spark = df.sparkSession
    folder = folder or scratch_path(spark, "evaluation")
    rows = kfold(df.where(F.col(label).isNotNull()), key, n_folds, seed=seed, salt="outer", out="_fold").checkpoint(eager=True)
    failures = []
    for name, (kind, grid) in estimators.items():
        for f in range(n_folds):
            path = f"{folder}/predictions/model={name}/fold={f}"
            if _exists(spark, f"{path}/_SUCCESS"):
                continue
            try:
                train, test = rows.where(F.col("_fold") != f), rows.where(F.col("_fold") == f)
                pred, scaler, model = _unit(train.drop("_fold"), test.drop("_fold"), key, list(feature_cols), label, kind,
                                            grid, scale, inner_folds, seed, weight_col)
                pred.write.mode("overwrite").parquet(path)
            except Exception as e:   # a failing fit is a result of the evaluation, unless asked otherwise
                if error_score == "raise":
                    raise
                failures.append((name, f, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"))
    failed = spark.createDataFrame(failures, "model string, fold int, error string")
    if len(failures) == n_folds * len(estimators):
        raise RuntimeError(f"every fit failed, the first with {failures[0][2]}")
    regression = not sorts.pop()
    kind_of = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind_of}, known double, prediction double" + ("" if regression else ", prob0 double, prob1 double") \
        + ", model string, fold int"
    return Evaluation(folder, spark.read.schema(schema).parquet(f"{folder}/predictions"), failed, key, regression)


def hold_out(train: DataFrame, test: DataFrame, key: str, feature_cols: Sequence[str], label: str,
             estimators: dict[str, tuple[str, Sequence[dict]]], inner_folds: int = 5, scale: str | None = "minmax",
             seed: int = 42, weight_col: str | None = None, folder: str | None = None) -> tuple[DataFrame, str]:
    """Fit several estimators on ``train``; predictions of both sets ``(model, set, key, known,
    prediction[, ...])`` and the folder that holds them, every model and the scaler."""
    spark = train.sparkSession
    folder = folder or scratch_path(spark, "hold-out")
    for name, (kind, grid) in estimators.items():
        both = train.withColumn("_set", F.lit("train")).unionByName(test.withColumn("_set", F.lit("test")), allowMissingColumns=True)
        pred, scaler, model = _unit(train, both.drop("_set"), key, list(feature_cols), label, kind, grid, scale,
                                    inner_folds, seed, weight_col)
        pred.join(both.select(key, F.col("_set").alias("set")), key).write.mode("overwrite") \
            .parquet(f"{folder}/predictions/model={name}")
        save_model(model, f"{folder}/models/{name}", overwrite=True)
        if scaler is not None and scale == "minmax":
            save_model(scaler, f"{folder}/scaler", overwrite=True)
    return spark.read.parquet(f"{folder}/predictions"), folder
