"""Grid search, hold-out and nested cross-validation, importances.

Folds are a column (hash-seeded, sizes differ by ≤ 1).  Every fit and every
score is a distributed job; the driver loops over (candidate, fold) and keeps
only scores — a table bounded by the grid size × folds × metrics.  Fold
tables are persisted once and released at the end.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moltab.operators import gram, metrics, models
from moltab.operators.curves import curve_summary
from moltab.operators.neighbors import neighbour_lists, predictions, usable
from moltab.operators.splits import kfold
from moltab.session import released, stored

CLF_SCORING = ("roc_auc", "precision", "recall")
REG_SCORING = ("r2", "neg_root_mean_squared_error")


def assemble(df: DataFrame, key: str, feature_cols: Sequence[str], label: str | None = None) -> DataFrame:
    """``(key, features VECTOR[, label DOUBLE])`` with MLlib's ``VectorAssembler``."""
    va = VectorAssembler(inputCols=list(feature_cols), outputCol=models.FEATURES, handleInvalid="keep")
    cols = [key, models.FEATURES] + ([F.col(label).cast("double").alias(models.LABEL)] if label else [])
    return va.transform(df).select(*cols)


def _scores(pred: DataFrame, scoring: Sequence[str], by: Sequence[str]) -> DataFrame:
    """All scorers for every group of ``by`` in one job each kind."""
    by = list(by)
    out = None
    need_clf = any(s in ("roc_auc", "precision", "recall", "accuracy", "f1") for s in scoring)
    if need_clf:
        r = metrics.with_rates(metrics.confusion(pred, models.LABEL, "prediction", by=by, positive=1.0))
        if "roc_auc" in scoring and "prob1" in pred.columns:
            r = r.join(curve_summary(pred, models.LABEL, "prob1", by=by, positive=1.0), by, "left")
        out = r
    if any(s in ("r2", "neg_root_mean_squared_error", "neg_mean_absolute_error") for s in scoring):
        m = metrics.metrics_regression(pred, models.LABEL, "prediction", by=by) \
            .withColumn("neg_root_mean_squared_error", -F.col("rmse")) \
            .withColumn("neg_mean_absolute_error", -F.col("mae"))
        out = m if out is None else out.join(m, by)
    long = None
    for s in scoring:
        part = out.select(*by, F.lit(s).alias("metric"), F.col(s).cast("double").alias("score"))
        long = part if long is None else long.unionByName(part)
    return long


def grid_search(data: DataFrame, key: str, kind: str, grid: Sequence[dict], n_folds: int = 5,
                scoring: Sequence[str] | None = None, seed: int = 42, salt: str = "inner",
                weight_col: str | None = None, parallelism: int | None = None) -> DataFrame:
    """Exhaustive grid × cv folds, train and test scores: long table
    ``(cand_id, params, split, set, metric, score)``.  ``data`` holds key, features, label.

    (candidate, fold) fits are independent Spark jobs submitted from a thread
    pool (like ``CrossValidator(parallelism=…)``), so small fits share the
    cluster instead of running one after another.  The candidates of kNN models share
    one search.
    """
    from concurrent.futures import ThreadPoolExecutor

    spark = data.sparkSession
    scoring = list(scoring or (CLF_SCORING if kind in models.CLASSIFIERS else REG_SCORING))
    if kind in models.NEAREST:
        return _nearest_grid(data, key, kind, grid, n_folds, scoring, seed, salt)
    folds = kfold(data, key, n_folds, seed=seed, salt=salt).persist()
    folds.count()  # materialise once before the concurrent fits read it

    def run(task):
        cid, params, f = task
        tr = folds.where(F.col("fold") != f)
        te = folds.where(F.col("fold") == f)
        m = models.make(kind, **params).fit(tr, weight_col)
        both = (m.transform(te).withColumn("set", F.lit("test"))
                .unionByName(m.transform(tr).withColumn("set", F.lit("train")), allowMissingColumns=True))
        # several scoring jobs read the predictions: compute them once
        both = both.select("set", models.LABEL, "prediction", *(["prob1"] if "prob1" in both.columns else [])).persist()
        try:
            return [(cid, json.dumps(params, sort_keys=True), f, r["set"], r["metric"],
                     None if r["score"] is None else float(r["score"]))
                    for r in _scores(both, scoring, ["set"]).collect()]
        finally:
            both.unpersist()

    tasks = [(cid, params, f) for cid, params in enumerate(grid) for f in range(n_folds)]
    par = parallelism or _default_parallelism(spark)
    try:
        with ThreadPoolExecutor(max_workers=max(1, min(par, len(tasks)))) as pool:
            rows = [r for chunk in pool.map(run, tasks) for r in chunk]
    finally:
        folds.unpersist()
    return spark.createDataFrame(rows, GRID_KIND)


GRID_KIND = "cand_id int, params string, split int, set string, metric string, score double"


def _nearest_grid(data: DataFrame, key: str, kind: str, grid: Sequence[dict], n_folds: int, scoring: Sequence[str],
                  seed: int, salt: str) -> DataFrame:
    """:func:`grid_search` of kNN models by one search: every row gets all rows that are among
    its nearest whichever fold is left out, and each candidate predicts every row in every
    split from the first of them that it trains on."""
    spark = data.sparkSession
    ks = [int(p.get("n_neighbors", 5)) for p in grid]
    rows = data.select(F.lit(0).alias("g"), F.col(key).alias("id"), vector_to_array(models.FEATURES).alias("v"),
                       F.col(models.LABEL).cast("double").alias("y"))
    with released(spark):
        with released(spark) as keep:
            folds = usable(keep(stored(kfold(rows, "id", n_folds, seed=seed, salt=salt), "knn-folds")))
        lists = neighbour_lists(folds.select("g", "id", "v", F.col("y").alias(models.LABEL), "fold"),
                                folds.select("g", "id", "v", "y", F.col("fold").alias("part")), max(ks))
        if lists is None:
            raise ValueError("no rows to learn from")
        pred = predictions(lists, ks, kind == "knn_reg", [models.LABEL, "fold"], n_folds) \
            .withColumn("set", F.when(F.col("fold") == F.col("split"), "test").otherwise("train"))
        scores = _scores(pred, scoring, ["cand_id", "split", "set"]).collect()
    told = sorted((r["cand_id"], json.dumps(grid[r["cand_id"]], sort_keys=True), r["split"], r["set"], r["metric"],
                   None if r["score"] is None else float(r["score"])) for r in scores)
    return spark.createDataFrame(told, GRID_KIND)


def _default_parallelism(spark) -> int:
    return int(spark.conf.get("moltab.fit.parallelism", "4"))


def grid_summary(grid_long: DataFrame) -> DataFrame:
    """mean / population std per candidate, and the min-rank by mean test score."""
    from pyspark.sql import Window
    s = grid_long.groupBy("cand_id", "params", "set", "metric").agg(
        F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("std_score"))
    w = Window.partitionBy("set", "metric").orderBy(F.col("mean_score").desc_nulls_last())
    return s.withColumn("rank", F.rank().over(w))


def best_params(grid_long: DataFrame, metric: str) -> dict:
    best = (grid_summary(grid_long).where((F.col("set") == "test") & (F.col("metric") == metric))
            .orderBy(F.col("rank"), F.col("cand_id")).first())
    return json.loads(best["params"])


def split_test(train: DataFrame, test: DataFrame, key: str, kind: str, grid: Sequence[dict],
               n_folds: int = 5, scoring: Sequence[str] | None = None, seed: int = 42,
               weight_col: str | None = None, final_weights_only: bool = False,
               parallelism: int | None = None):
    """Hold-out workflow: grid on train, refit the best on all train rows, predict test.
    Returns ``(predictions, grid_long, fitted_model)``; predictions hold
    ``(key, known, prediction, prob0, prob1)`` for classifiers."""
    scoring = list(scoring or (CLF_SCORING if kind in models.CLASSIFIERS else REG_SCORING))
    g = grid_search(train, key, kind, grid, n_folds, scoring, seed,
                    weight_col=None if final_weights_only else weight_col, parallelism=parallelism)
    params = best_params(g, scoring[0])
    model = models.make(kind, **params, **({"key": key} if kind in models.NEAREST else {})).fit(train, weight_col)
    pred = model.transform(test)
    cols = [key, F.col(models.LABEL).alias("known"), "prediction"]
    if "prob1" in pred.columns:
        cols += [(1 - F.col("prob1")).alias("prob0"), "prob1"]
    return pred.select(*cols), g, model


def nested_cv(data: DataFrame, key: str, kind: str, grid: Sequence[dict], n_folds: int = 5,
              inner_folds: int = 3, scoring: Sequence[str] | None = None, seed: int = 42,
              model_name: str | None = None, weight_col: str | None = None) -> DataFrame:
    """Outer k folds; per fold an inner grid search on the training part, refit, predict
    the held-out fold.  ``(model, fold, key, known, prediction[, prob0, prob1])``.
    With ``weight_col`` the class weights apply to the final fit of each fold only,
    as in the reference's weighted variant."""
    from concurrent.futures import ThreadPoolExecutor

    outer = kfold(data, key, n_folds, seed=seed, salt="outer").persist()
    outer.count()

    def run(f):
        tr = outer.where(F.col("fold") != f).drop("fold")
        te = outer.where(F.col("fold") == f).drop("fold")
        pred, _, _ = split_test(tr, te, key, kind, grid, inner_folds, scoring, seed,
                                weight_col=weight_col, final_weights_only=True, parallelism=1)
        pred = pred.select(F.lit(model_name or kind).alias("model"), F.lit(f).alias("fold"), "*")
        return pred.checkpoint(eager=True)  # reliable checkpoint: survives executor loss, cuts lineage

    try:
        with ThreadPoolExecutor(max_workers=max(1, min(_default_parallelism(data.sparkSession), n_folds))) as pool:
            parts = list(pool.map(run, range(n_folds)))
    finally:
        outer.unpersist()
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ------------------------------------------------------------ importances

def coef_nonzero(model, feature_names: Sequence[str]) -> DataFrame:
    """Selected features of an L1 model: ``(feature, coef)`` for non-zero
    coefficients plus the ``intercept`` row."""
    spark = SparkSession.getActiveSession()
    m = model.model if hasattr(model, "model") else model
    coefs = m.coefficients.toArray().tolist()
    rows = [(n, float(c)) for n, c in zip(feature_names, coefs) if c != 0] + [("intercept", float(m.intercept))]
    return spark.createDataFrame(rows, "feature string, coef double")


def permutation_importance(model, data: DataFrame, key: str, feature_cols: Sequence[str], label: str,
                           n_repeats: int = 5, seed: int = 0, regression: bool = False) -> DataFrame:
    """Baseline score − score with one feature permuted; mean and population std over
    repeats; ``(feature, importance, importance_std, importance_abs)``.

    The permuted column is taken from the row holding the same position in the hash
    order of (key, feature, repeat) as this row holds in key order (exact permutation,
    distributed row numbers within each copy).  The rows are read and numbered in key order
    once; of a copy only the hash and the one value it moves are ordered and shuffled.
    """
    from moltab.functions.rng import hash32
    from moltab.operators.ordered import row_number

    cols = [f"x{i}" for i in range(len(feature_cols))]
    base = data.select(F.col(key).alias("_key"), *[F.col(c).cast("double").alias(x) for c, x in zip(feature_cols, cols)],
                       F.col(label).alias("_y"))
    rows = stored(row_number(base.withColumn("_k", hash32(F.col("_key"), "key")), "_k", tiebreak=["_key"],
                             out="_pos").drop("_k"), "importance-rows")
    copies = [(j, r) for j in range(len(feature_cols)) for r in range(n_repeats)]
    moved = F.explode(F.array(*[F.struct(
        F.lit(t).alias("t"), hash32(F.col("_key"), seed, F.lit(feature_cols[j]), F.lit(r)).alias("_h"),
        F.col(cols[j]).alias("v")) for t, (j, r) in enumerate(copies)]))
    ranked = row_number(rows.select("_key", moved.alias("m")).select("_key", "m.*"), "_h", tiebreak=["_key"],
                        by=["t"], out="_pos")
    j = F.floor(F.col("t") / n_repeats).cast("int")
    permuted = ranked.select("t", "_pos", "v").join(rows, "_pos").select(
        "_y", F.element_at(F.array(*map(F.lit, feature_cols)), j + 1).alias("feat"), (F.col("t") % n_repeats).alias("rep"),
        *[F.when(j == i, F.col("v")).otherwise(F.col(c)).alias(c) for i, c in enumerate(cols)])
    scored_p = model.transform(assemble_keep(permuted, cols, "_y", ["feat", "rep"]))
    scored_b = model.transform(assemble_keep(rows, cols, "_y", []))
    metric = _score_expr(regression)
    b = scored_b.agg(metric.alias("base")).first()["base"]
    per = scored_p.groupBy("feat", "rep").agg(metric.alias("s"))
    imp = per.select("feat", (F.lit(b) - F.col("s")).alias("d")).groupBy("feat").agg(
        F.avg("d").alias("importance"), F.stddev_pop("d").alias("importance_std"))
    return imp.select(F.col("feat").alias("feature"), "importance", "importance_std",
                      F.abs("importance").alias("importance_abs"))


def assemble_keep(df: DataFrame, feature_cols, label, keep) -> DataFrame:
    va = VectorAssembler(inputCols=list(feature_cols), outputCol=models.FEATURES, handleInvalid="keep")
    return va.transform(df).select(*keep, models.FEATURES, F.col(label).cast("double").alias(models.LABEL))


def _score_expr(regression: bool):
    y, yh = F.col(models.LABEL), F.col("prediction")
    if regression:
        return 1 - F.sum((y - yh) * (y - yh)) / (F.count(F.lit(1)) * F.var_pop(y))
    return F.avg((y == yh).cast("double"))


# ------------------------------------------------------------ PCA

def pca(data: DataFrame, feature_cols: Sequence[str], k: int | None = None):
    """PCA on centred features (MLlib computes the covariance distributedly);
    returns ``(model, explained DataFrame(k, ratio), loadings DataFrame(component, feature, loading))``."""
    from pyspark.ml.feature import PCA, StandardScaler
    spark = data.sparkSession
    va = VectorAssembler(inputCols=list(feature_cols), outputCol="_raw", handleInvalid="skip")
    d = va.transform(data)
    sc = StandardScaler(inputCol="_raw", outputCol="_c", withMean=True, withStd=False).fit(d)
    d = sc.transform(d)
    k = k or len(feature_cols)
    m = PCA(k=k, inputCol="_c", outputCol="pca").fit(d)
    ev = [(i + 1, float(v)) for i, v in enumerate(m.explainedVariance.toArray())]
    pc = m.pc.toArray()
    load = [(i + 1, f, float(pc[j, i])) for i in range(k) for j, f in enumerate(feature_cols)]
    return (m, spark.createDataFrame(ev, "k int, ratio double"),
            spark.createDataFrame(load, "component int, feature string, loading double"))


def vif(data: DataFrame, feature_cols: Sequence[str], threshold: float = 10.0) -> DataFrame:
    """Variance inflation factors: diagonal of the inverse correlation matrix
    (one blocked Gram pass; p×p solves on the driver).
    ``(feature, vif, keep)`` with keep = vif ≤ threshold."""
    spark = data.sparkSession
    rows = [(f, v, v is not None and v <= threshold) for f, v in
            zip(feature_cols, gram.variance_inflation(data, list(feature_cols)))]
    return spark.createDataFrame(rows, "feature string, vif double, keep boolean")
