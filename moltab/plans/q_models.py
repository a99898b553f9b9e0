"""Registered queries: training, importance, resampling, neighbours, PCA (§2.3, §2.10-2.12).

Datasets derived from the driver tables:

* classification — ``labels`` ⋈ ``documents``: text statistics as features,
  ``quality`` as the class;
* regression — ``orders`` ⋈ line aggregates of ``lineitem``: order features,
  total price (in 100k) as the target.

Trained models are checked rows-only (row counts are fixed by the splits);
operators with a closed form (Shapley values of a fixed linear model,
correlation selection, SMOTE counts, exact kNN) carry SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from moltab.operators import explain, gram, models, resample, stats
from moltab.functions.rng import sql_hash32, sql_key, sql_lit
from moltab.operators.neighbors import knn
from moltab.operators.permutation import permutation_test, sql_permuted
from moltab.operators.splits import class_weights, kfold, split_random
from moltab.plans import training
from moltab.plans.common import round_doubles
from moltab.plans.registry import register, table
from moltab.session import released, scratch_path, stored
from moltab.sources.models import load_model, save_model

CLF_FEATS = ["f_len", "f_en", "f_fr", "f_de", "f_digits", "f_lines", "f_upper"]
REG_FEATS = ["n_lines", "qty", "disc", "tax", "price_k"]


def clf_data(spark, sf):
    d = table(spark, sf, "documents")
    lab = table(spark, sf, "labels")
    j = d.join(lab, "doc_id")
    return j.select("doc_id", (F.col("n_chars") / 1000.0).alias("f_len"),
                    (F.col("lang") == "en").cast("double").alias("f_en"),
                    (F.col("lang") == "fr").cast("double").alias("f_fr"),
                    (F.col("lang") == "de").cast("double").alias("f_de"),
                    (F.regexp_count("text", F.lit("[0-9]")) / 100.0).alias("f_digits"),
                    (F.regexp_count("text", F.lit("\n")) / 10.0).alias("f_lines"),
                    (F.regexp_count("text", F.lit("[A-Z]")) / 100.0).alias("f_upper"),
                    F.col("quality").cast("double").alias("quality"))


def reg_data(spark, sf):
    o = table(spark, sf, "orders")
    li = table(spark, sf, "lineitem")
    a = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).cast("double").alias("n_lines"), (F.sum("l_quantity") / 100).alias("qty"),
        (F.avg("l_discount") * 10).alias("disc"), (F.avg("l_tax") * 10).alias("tax"),
        (F.sum("l_extendedprice") / 1e5).alias("price_k"))
    return o.join(a, "o_orderkey").select("o_orderkey", *REG_FEATS, (F.col("o_totalprice") / 1e5).alias("target"))


def _checkpointed(data):
    return data.checkpoint(eager=True)


def _clf_split(spark, sf, cut=_checkpointed):
    d = split_random(clf_data(spark, sf), "doc_id", 0.2, seed=42)
    data = d.select("doc_id", "is_test").join(training.assemble(d, "doc_id", CLF_FEATS, "quality"), "doc_id")
    # the assembled table feeds many fits: cut its lineage once (reliable checkpoint)
    data = cut(data)
    return data.where(~F.col("is_test")).drop("is_test"), data.where("is_test").drop("is_test")


def _reg_split(spark, sf, cut=_checkpointed):
    d = split_random(reg_data(spark, sf), "o_orderkey", 0.2, seed=42)
    data = d.select("o_orderkey", "is_test").join(training.assemble(d, "o_orderkey", REG_FEATS, "target"), "o_orderkey")
    data = cut(data)
    return data.where(~F.col("is_test")).drop("is_test"), data.where("is_test").drop("is_test")


#: The reference's candidates and folds of kNN models.
NEIGHBOURS, NEIGHBOUR_FOLDS = [{"n_neighbors": k} for k in range(2, 10)], 5
CLF_MODELS = {
    "m_logreg": ("logreg", [{"C": 0.75}, {"C": 1.5}]),
    "m_dtree_clf": ("dtree_clf", [{"max_depth": 2}, {"max_depth": 4}]),
    "m_forest_clf": ("forest_clf", [{"n_estimators": 10, "max_depth": 4}]),
    "m_extratrees": ("extratrees", [{"n_estimators": 10, "max_depth": 4}]),
    "m_adaboost": ("adaboost", [{"n_estimators": 3}]),
    "m_knn_clf": ("knn_clf", NEIGHBOURS),
    "m_kernel_clf": ("kernel_clf", [{"n_components": 30, "length_scale": 2.0}]),
}
REG_MODELS = {
    "m_dtree_reg": ("dtree_reg", [{"max_depth": 3}, {"max_depth": 5}]),
    "m_forest_reg": ("forest_reg", [{"n_estimators": 10, "max_depth": 4}]),
    "m_lasso_one_alpha": ("lasso", [{"alpha": 0.001}, {"alpha": 0.01}, {"alpha": 0.1}]),
    "m_knn_reg": ("knn_reg", NEIGHBOURS),
    "m_kernel_reg": ("kernel_reg", [{"n_components": 30, "length_scale": 2.0}]),
    "m_bayes_ridge": ("bayes_ridge", [{}]),
}


def _clf_query(kind, grid):
    def q(spark, sf):
        tr, te = _clf_split(spark, sf)
        pred, _, _ = training.split_test(tr, te, "doc_id", kind, grid, n_folds=3)
        return pred.select("doc_id", "known", F.col("prediction").cast("int").alias("prediction"))
    return q


def _reg_query(kind, grid):
    def q(spark, sf):
        tr, te = _reg_split(spark, sf)
        pred, _, _ = training.split_test(tr, te, "o_orderkey", kind, grid, n_folds=3)
        return pred.select("o_orderkey", "known", "prediction")
    return q


def _nearest_query(split, key, kind, grid):
    """All candidates in all folds; only the predictions stay on disk."""
    def q(spark, sf):
        with released(spark) as keep:
            with released(spark) as keep_split:
                tr, te = split(spark, sf, lambda data: keep_split(stored(data, "split")))
            pred, _, _ = training.split_test(tr, te, key, kind, grid, n_folds=NEIGHBOUR_FOLDS)
            shown = F.col("prediction").cast("int").alias("prediction") if kind in models.CLASSIFIERS else "prediction"
            return keep(stored(pred.select(key, "known", shown), "predictions"))
    return q


for _id, (_kind, _grid) in CLF_MODELS.items():
    register(_id)(_nearest_query(_clf_split, "doc_id", _kind, _grid) if _kind in models.NEAREST else _clf_query(_kind, _grid))
for _id, (_kind, _grid) in REG_MODELS.items():
    register(_id)(_nearest_query(_reg_split, "o_orderkey", _kind, _grid) if _kind in models.NEAREST else _reg_query(_kind, _grid))


def _gram_query(kind, **params):
    def q(spark, sf):
        tr, te = _reg_split(spark, sf)
        model = models.make(kind, key="o_orderkey", n_folds=10, **params).fit(tr)
        return model.transform(te).select("o_orderkey", F.col("label").alias("known"), "prediction")
    return q


#: The whole path of 100 alphas in 10 folds, and a grid of priors, each from one Gram pass.
register("m_lasso_cv")(_gram_query("lasso_cv", n_alphas=100))
PRIORS = [{"alpha_1": a, "lambda_1": b} for a in (1e-6, 1e-3, 1.0) for b in (1e-6, 1e-3, 1.0)]
register("m_bayes_ridge_grid")(_gram_query("bayes_ridge_cv", grid=PRIORS))

_REG_SQL = """(SELECT o_orderkey, n_lines, qty, disc, tax, price_k, o_totalprice / 1e5 AS target FROM orders JOIN (
  SELECT l_orderkey AS o_orderkey, count(*)::DOUBLE AS n_lines, sum(l_quantity) / 100 AS qty, avg(l_discount) * 10 AS disc,
    avg(l_tax) * 10 AS tax, sum(l_extendedprice) / 1e5 AS price_k FROM lineitem GROUP BY l_orderkey) USING (o_orderkey))"""


def q_lasso_cv_path(spark, sf):
    """Cross-validated errors of the whole path for one feature, where soft thresholding is
    the exact answer."""
    d = kfold(reg_data(spark, sf), "o_orderkey", 10, seed=42, out="_fold")
    _, _, _, path = gram.lasso_cv(gram.moments(d, ["price_k", "target"], fold="_fold"))
    out = spark.createDataFrame(path, "alpha double, fold int, mse double")
    return round_doubles(out.groupBy(F.round("alpha", 9).alias("alpha")).agg(F.avg("mse").alias("mse")))


register("lasso_cv_path", f"""WITH d AS (SELECT price_k AS x, target AS y, ntile(10) OVER (
    ORDER BY {sql_hash32(sql_key("o_orderkey"), sql_lit(42), sql_lit("kfold"))}, o_orderkey) AS fold FROM {_REG_SQL}),
whole AS (SELECT abs(covar_pop(x, y)) AS top FROM d),
alphas AS (SELECT top * power(0.001, k / 99.0) AS alpha FROM whole, (SELECT unnest(range(100)) AS k)),
train AS (SELECT f AS fold, covar_pop(x, y) AS c, var_pop(x) AS v, avg(x) AS mx, avg(y) AS my
          FROM d, (SELECT unnest(range(1, 11)) AS f) WHERE d.fold <> f GROUP BY f),
w AS (SELECT fold, alpha, sign(c) * greatest(abs(c) - alpha, 0) / v AS w, mx, my FROM train, alphas),
mse AS (SELECT fold, alpha, avg(power(d.y - w.my - w.w * (d.x - w.mx), 2)) AS mse FROM w JOIN d USING (fold) GROUP BY fold, alpha)
SELECT round(round(alpha, 9), 6) AS alpha, round(avg(mse), 6) AS mse FROM mse GROUP BY round(alpha, 9)""")(q_lasso_cv_path)


def q_pca_whiten(spark, sf):
    d = reg_data(spark, sf)
    fitted = gram.pca(d, ["qty", "price_k"], keep=2, whiten=True, standardise=True)
    return round_doubles(fitted.transform(d).select("o_orderkey", "pc1", "pc2"))


register("pca_whiten", f"""WITH d AS (SELECT o_orderkey, qty, price_k FROM {_REG_SQL}),
m AS (SELECT avg(qty) AS a, stddev_samp(qty) AS sa, avg(price_k) AS b, stddev_samp(price_k) AS sb, corr(qty, price_k) AS r FROM d)
SELECT o_orderkey, round(((qty - a) / sa + (price_k - b) / sb) / sqrt(2 * (1 + r)), 6) AS pc1,
  round(((qty - a) / sa - (price_k - b) / sb) / sqrt(2 * (1 - r)), 6) AS pc2 FROM d, m""")(q_pca_whiten)


def q_vif_three(spark, sf):
    return round_doubles(training.vif(reg_data(spark, sf), ["n_lines", "qty", "price_k"], 5.0))


register("vif_three", f"""WITH r AS (SELECT corr(n_lines, qty) AS ab, corr(n_lines, price_k) AS ac, corr(qty, price_k) AS bc FROM {_REG_SQL}),
v AS (SELECT *, 1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc AS det FROM r),
l AS (SELECT 'n_lines' AS feature, (1 - bc * bc) / det AS vif FROM v UNION ALL SELECT 'qty', (1 - ac * ac) / det FROM v
      UNION ALL SELECT 'price_k', (1 - ab * ab) / det FROM v)
SELECT feature, round(vif, 6) AS vif, vif <= 5 AS keep FROM l""")(q_vif_three)


def q_split_clf(spark, sf):
    tr, te = _clf_split(spark, sf)
    out = None
    for name, (kind, grid) in [("logreg", CLF_MODELS["m_logreg"]), ("dtree", CLF_MODELS["m_dtree_clf"])]:
        pred, _, _ = training.split_test(tr, te, "doc_id", kind, grid, n_folds=3)
        from moltab.operators.metrics import metrics_binary
        m = metrics_binary(pred.withColumn("model", F.lit(name)), "known", "prediction", score="prob1",
                           by=["model"], positive=1.0)
        out = m if out is None else out.unionByName(m)
    return out


register("split_clf")(q_split_clf)


def q_split_reg(spark, sf):
    from moltab.operators.metrics import metrics_regression
    tr, te = _reg_split(spark, sf)
    kind, grid = REG_MODELS["m_lasso_one_alpha"]
    _, _, model = training.split_test(tr, te, "o_orderkey", kind, grid, n_folds=3)
    both = (model.transform(tr).withColumn("set", F.lit("train"))
            .unionByName(model.transform(te).withColumn("set", F.lit("test"))))
    return metrics_regression(both, "label", "prediction", by=["set"], rounded=True)


register("split_reg")(q_split_reg)


def q_grid_clf(spark, sf):
    tr, _ = _clf_split(spark, sf)
    g = training.grid_search(tr, "doc_id", "logreg", [{"C": 0.75}, {"C": 1.0}, {"C": 1.5}], n_folds=5)
    return training.grid_summary(g)


register("grid_clf")(q_grid_clf)


def q_grid_reg(spark, sf):
    tr, _ = _reg_split(spark, sf)
    g = training.grid_search(tr, "o_orderkey", "dtree_reg", [{"max_depth": 2}, {"max_depth": 4}], n_folds=5)
    return training.grid_summary(g)


register("grid_reg")(q_grid_reg)


def q_kfold_reg(spark, sf):
    tr, te = _reg_split(spark, sf)
    data = tr.unionByName(te)
    return training.nested_cv(data, "o_orderkey", "lasso", [{"alpha": 0.01}], n_folds=3, inner_folds=2)


register("kfold_reg")(q_kfold_reg)


def q_kfold_clf(spark, sf):
    tr, te = _clf_split(spark, sf)
    return training.nested_cv(tr.unionByName(te), "doc_id", "logreg", [{"C": 1.0}], n_folds=3, inner_folds=2)


register("kfold_clf")(q_kfold_clf)


def q_kfold_clf_weights(spark, sf):
    tr, te = _clf_split(spark, sf)
    data = class_weights(tr.unionByName(te), "label", "balanced", out="w")
    return training.nested_cv(data, "doc_id", "logreg", [{"C": 1.0}], n_folds=3, inner_folds=2, weight_col="w")


register("kfold_clf_weights")(q_kfold_clf_weights)


def q_coef_importance(spark, sf):
    tr, _ = _clf_split(spark, sf)
    m = models.make("logreg", C=1.0).fit(tr)
    return explain.coef_importance(m.model, CLF_FEATS)


register("coef_importance")(q_coef_importance)


def q_bit_importance(spark, sf):
    from moltab.operators import fingerprints as fp
    from moltab.plans.q_fingerprints import TEXT_KEYS
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    bits = fp.pattern_fp(d, "doc_id", "text", TEXT_KEYS).join(d.select("doc_id", "quality"), "doc_id")
    cols = fp.fp_to_columns(bits, "doc_id", "bits", 21).join(d.select("doc_id", "quality"), "doc_id")
    feats = [f"fp_{k}" for k in range(21)]
    data = training.assemble(cols, "doc_id", feats, "quality")
    m = models.make("forest_clf", n_estimators=10, max_depth=4).fit(data)
    return explain.bit_importance(explain.coef_importance(m.model, feats), 21)


register("bit_importance")(q_bit_importance)


def q_perm_importance(spark, sf):
    d = clf_data(spark, sf)
    data = training.assemble(d, "doc_id", CLF_FEATS, "quality")
    m = models.make("logreg", C=1.0).fit(data)
    return training.permutation_importance(m, d, "doc_id", CLF_FEATS, "quality", n_repeats=5, seed=0)


register("perm_importance")(q_perm_importance)


def q_coef_nonzero(spark, sf):
    tr, _ = _reg_split(spark, sf)
    m = models.make("lasso", alpha=0.01).fit(tr)
    return training.coef_nonzero(m, REG_FEATS)


register("coef_nonzero")(q_coef_nonzero)


def q_pca(spark, sf):
    _, ev, _ = training.pca(reg_data(spark, sf), REG_FEATS)
    return ev


register("pca")(q_pca)


def q_cum_variance(spark, sf):
    from moltab.operators.reports import cum_variance
    _, ev, _ = training.pca(reg_data(spark, sf), REG_FEATS)
    return cum_variance(ev, 0.95)


register("cum_variance")(q_cum_variance)


def q_pca_select(spark, sf):
    from moltab.operators.reports import argmax_abs
    _, _, load = training.pca(reg_data(spark, sf), REG_FEATS, k=3)
    return argmax_abs(load, "component", "feature", "loading").select("component", "feature")


register("pca_select")(q_pca_select)


def q_drop_high_vif(spark, sf):
    return training.vif(reg_data(spark, sf), REG_FEATS, 10.0)


register("drop_high_vif")(q_drop_high_vif)


# ------------------------------------------------------------ closed forms with SQL

SHAP_W = {"f_len": 0.5, "f_digits": -1.25, "f_lines": 2.0}


def q_shap_linear(spark, sf):
    d = clf_data(spark, sf)
    return round_doubles(explain.shap_linear(d, "doc_id", list(SHAP_W), SHAP_W))


_CLF_SQL = """(SELECT doc_id, n_chars / 1000.0 AS f_len, len(regexp_extract_all(text, '[0-9]')) / 100.0 AS f_digits,
  len(regexp_extract_all(text, '\n')) / 10.0 AS f_lines FROM documents JOIN labels USING (doc_id))"""
register("shap_linear", f"""WITH d AS {_CLF_SQL}, m AS (SELECT avg(f_len) AS a, avg(f_digits) AS b, avg(f_lines) AS c FROM d)
SELECT doc_id, 'f_len' AS feature, round(0.5 * (f_len - a), 6) AS phi FROM d, m
UNION ALL SELECT doc_id, 'f_digits', round(-1.25 * (f_digits - b), 6) FROM d, m
UNION ALL SELECT doc_id, 'f_lines', round(2.0 * (f_lines - c), 6) FROM d, m""")(q_shap_linear)


def q_corr_select(spark, sf):
    d = clf_data(spark, sf)
    return round_doubles(stats.corr_select(d, ["f_len", "f_digits", "f_lines", "f_upper"], "quality",
                                           "pearson", thresh=0.05).drop("p_value", "significant"))


register("corr_select", f"""WITH d AS (SELECT doc_id, n_chars / 1000.0 AS f_len, len(regexp_extract_all(text, '[0-9]')) / 100.0 AS f_digits,
  len(regexp_extract_all(text, '\n')) / 10.0 AS f_lines, len(regexp_extract_all(text, '[A-Z]')) / 100.0 AS f_upper,
  CAST(quality AS DOUBLE) AS y FROM documents JOIN labels USING (doc_id)),
l AS (SELECT 'f_len' AS feature, f_len AS v, y FROM d UNION ALL SELECT 'f_digits', f_digits, y FROM d
      UNION ALL SELECT 'f_lines', f_lines, y FROM d UNION ALL SELECT 'f_upper', f_upper, y FROM d)
SELECT feature, round(CAST(count(*) FILTER (WHERE v IS NULL) AS DOUBLE) / count(*), 6) AS null_frac,
  count(*) FILTER (WHERE v IS NOT NULL AND y IS NOT NULL) AS n,
  round(covar_pop(v, y) / nullif(sqrt(var_pop(v) * var_pop(y)), 0), 6) AS r,
  (CAST(count(*) FILTER (WHERE v IS NULL) AS DOUBLE) / count(*) < 0.7)
    AND coalesce(abs(covar_pop(v, y) / nullif(sqrt(var_pop(v) * var_pop(y)), 0)) > 0.05, false) AS selected
FROM l GROUP BY feature""")(q_corr_select)


PERM_FEATS = ["f_len", "f_digits", "f_lines", "f_upper"]
N_PERM, PERM_SEED = 10_000, 2024
_FEATS_SQL = """(SELECT doc_id, n_chars / 1000.0 AS f_len, CAST(lang = 'en' AS DOUBLE) AS f_en, CAST(lang = 'fr' AS DOUBLE) AS f_fr,
  CAST(lang = 'de' AS DOUBLE) AS f_de, len(regexp_extract_all(text, '[0-9]')) / 100.0 AS f_digits,
  len(regexp_extract_all(text, '\n')) / 10.0 AS f_lines, len(regexp_extract_all(text, '[A-Z]')) / 100.0 AS f_upper,
  CAST(quality AS DOUBLE) AS y FROM documents JOIN labels USING (doc_id))"""


def _perm_sql(feats: list[str], rank: bool, two_sided: bool, select: str) -> str:
    """p-values of correlations: the places of the permutations as arithmetic, one grouped
    sum per (feature, permutation)."""
    tied = lambda c: f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)"
    value = tied if rank else (lambda c: c)
    x = ", ".join(f"{value(c)} AS {c}" for c in feats)
    corr = "covar_pop(x, y) / nullif(sqrt(var_pop(x) * var_pop(y)), 0)"
    size = (lambda c: f"abs({c})") if two_sided else (lambda c: c)
    return f"""WITH pos AS (
  SELECT {x}, {value("y")} AS y, row_number() OVER (ORDER BY {sql_hash32(sql_key("doc_id"), sql_lit("key"))}, doc_id) - 1 AS i,
    count(*) OVER () AS n FROM {_FEATS_SQL}),
long AS (UNPIVOT (SELECT {", ".join(feats)}, y, i FROM pos) ON {", ".join(feats)} INTO NAME feature VALUE x),
obs AS (SELECT feature, count(*) AS n, {corr} AS r FROM long GROUP BY feature),
perm AS MATERIALIZED ({sql_permuted("SELECT i, n FROM pos", PERM_SEED, N_PERM)}),
moved AS (SELECT b, perm.i, y FROM perm JOIN pos ON pos.i = perm.p),
each AS (SELECT feature, b, {corr} AS rb FROM moved JOIN (SELECT feature, x, i FROM long) l USING (i) GROUP BY feature, b),
p AS (SELECT feature, obs.n, r, (1 + count(*) FILTER (WHERE {size("rb")} >= {size("r")} - 1e-12)) / {float(N_PERM + 1)} AS p
      FROM obs JOIN each USING (feature) GROUP BY feature, obs.n, r)
{select}"""


def q_perm_test(spark, sf):
    return round_doubles(permutation_test(clf_data(spark, sf), "doc_id", PERM_FEATS, "quality", "spearman",
                                          n_perm=N_PERM, seed=PERM_SEED))


register("perm_test", _perm_sql(PERM_FEATS, True, True, """SELECT feature, n, round(r, 6) AS r,
  CASE WHEN r IS NOT NULL THEN round(p, 6) END AS p_value FROM p"""))(q_perm_test)


def q_perm_test_greater(spark, sf):
    return round_doubles(permutation_test(clf_data(spark, sf), "doc_id", PERM_FEATS, "quality", "pearson",
                                          n_perm=N_PERM, seed=PERM_SEED, alternative="greater"))


register("perm_test_greater", _perm_sql(PERM_FEATS, False, False, """SELECT feature, n, round(r, 6) AS r,
  CASE WHEN r IS NOT NULL THEN round(p, 6) END AS p_value FROM p"""))(q_perm_test_greater)


def q_perm_test_all(spark, sf):
    d = clf_data(spark, sf)
    return round_doubles(stats.corr_select(d, CLF_FEATS, "quality", "pearson", thresh=0.0, key="doc_id",
                                           perm={"n_perm": N_PERM, "sig_level": 0.05, "seed": PERM_SEED}))


register("perm_test_all", _perm_sql(CLF_FEATS, False, True, """SELECT feature, 0.0::DOUBLE AS null_frac, n, round(r, 6) AS r,
  coalesce(abs(r) > 0, false) AS selected, CASE WHEN r IS NOT NULL THEN round(p, 6) END AS p_value,
  CASE WHEN r IS NOT NULL THEN p < 0.05 END AS significant FROM p"""))(q_perm_test_all)


def q_perm_test_kendall(spark, sf):
    return round_doubles(permutation_test(clf_data(spark, sf), "doc_id", ["f_lines"], "quality", "kendall",
                                          n_perm=N_PERM, seed=PERM_SEED))


register("perm_test_kendall", f"""WITH pos AS (
  SELECT f_lines AS x, y, row_number() OVER (ORDER BY {sql_hash32(sql_key("doc_id"), sql_lit("key"))}, doc_id) - 1 AS i,
    count(*) OVER () AS n FROM {_FEATS_SQL}),
perm AS MATERIALIZED ({sql_permuted("SELECT i, n FROM pos", PERM_SEED, N_PERM)}),
ties AS (SELECT (SELECT sum(t * (t - 1) / 2.0) FROM (SELECT count(*) AS t FROM pos GROUP BY x)) AS tx,
                (SELECT sum(t * (t - 1) / 2.0) FROM (SELECT count(*) AS t FROM pos GROUP BY y)) AS ty),
-- cells (x, y) of each permutation: the target has few values, so pairs of cells are few
cells AS (SELECT b, a.x, c.y, count(*) AS k FROM perm JOIN pos a ON a.i = perm.i JOIN pos c ON c.i = perm.p GROUP BY ALL
          UNION ALL SELECT 0, x, y, count(*) FROM pos GROUP BY ALL),
s AS (SELECT u.b, sum(u.k * v.k * sign(u.y - v.y)) AS s FROM cells u JOIN cells v ON u.b = v.b AND u.x > v.x GROUP BY u.b),
tau AS (SELECT b, s / nullif(sqrt(((SELECT any_value(n) * (any_value(n) - 1) / 2 FROM pos) - tx)
                                * ((SELECT any_value(n) * (any_value(n) - 1) / 2 FROM pos) - ty)), 0) AS t FROM s, ties)
SELECT 'f_lines' AS feature, (SELECT any_value(n) FROM pos) AS n, round(o.t, 6) AS r,
  round((1 + (SELECT count(*) FROM tau WHERE b > 0 AND abs(t) >= abs(o.t) - 1e-12)) / {float(N_PERM + 1)}, 6) AS p_value
FROM tau o WHERE o.b = 0""")(q_perm_test_kendall)


def q_perm_test_means(spark, sf):
    return round_doubles(permutation_test(clf_data(spark, sf), "doc_id", ["f_len", "f_lines"], "quality",
                                          "mean_difference", n_perm=N_PERM, seed=PERM_SEED))


register("perm_test_means", f"""WITH pool AS (
  SELECT 'f_len' AS feature, 0 AS side, doc_id::VARCHAR AS k, f_len AS v FROM {_FEATS_SQL}
  UNION ALL SELECT 'f_lines', 0, doc_id::VARCHAR, f_lines FROM {_FEATS_SQL}
  UNION ALL SELECT f, 1, doc_id::VARCHAR, y FROM {_FEATS_SQL}, (VALUES ('f_len'), ('f_lines')) t(f)),
pos AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY side, k) - 1 AS i, count(*) OVER (PARTITION BY feature) AS n FROM pool),
size AS (SELECT feature, any_value(n) AS n, count(*) FILTER (WHERE side = 0) AS m, sum(v) AS total,
           avg(v) FILTER (WHERE side = 0) - avg(v) FILTER (WHERE side = 1) AS r FROM pos GROUP BY feature),
perm AS MATERIALIZED ({sql_permuted("SELECT i, n FROM pos WHERE feature = 'f_len'", PERM_SEED, N_PERM)}),
each AS (SELECT s.feature, b, sum(q.v) / any_value(m) - (any_value(total) - sum(q.v)) / (any_value(s.n) - any_value(m)) AS rb
         FROM size s JOIN perm ON perm.i < s.m JOIN pos q ON q.feature = s.feature AND q.i = perm.p GROUP BY s.feature, b)
SELECT feature, m AS n, round(r, 6) AS r, round((1 + count(*) FILTER (WHERE abs(rb) >= abs(r) - 1e-12)) / {float(N_PERM + 1)}, 6) AS p_value
FROM size JOIN each USING (feature) GROUP BY feature, m, r""")(q_perm_test_means)


def q_smote(spark, sf):
    d = clf_data(spark, sf)
    data = d.select("doc_id", F.array("f_len", "f_digits", "f_lines").alias("v"),
                    F.col("quality").cast("int").alias("quality"))
    out = resample.smote(data, "doc_id", "v", "quality", k=5, seed=42)
    return out.groupBy("quality", "is_synthetic").agg(F.count(F.lit(1)).alias("n"))


register("smote", """WITH c AS (SELECT quality, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY quality),
m AS (SELECT max(n) AS mx FROM c)
SELECT quality, false AS is_synthetic, n FROM c
UNION ALL SELECT quality, true, mx - n FROM c, m WHERE mx > n""")(q_smote)


def q_knn_join(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label",
                                              F.col("embedding").cast("array<double>").alias("v"))
    return knn(e, e, "vec_id", "v", 3, by=["label"], exclude_self=True).select("label", "q", "p", "rank")


register("knn_join", """SELECT label, q, p, CAST(rank AS INTEGER) AS rank FROM (
  SELECT a.label, a.vec_id AS q, b.vec_id AS p,
    row_number() OVER (PARTITION BY a.label, a.vec_id ORDER BY
      sqrt(list_sum(list_transform(range(1, len(a.embedding) + 1),
        lambda i: (CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)) * (CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE))))),
      b.vec_id) AS rank
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id) WHERE rank <= 3""")(q_knn_join)


def q_smotenc(spark, sf):
    d = clf_data(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    out = resample.smotenc(d.select("doc_id", "f_len", "f_digits", "f_lines", "lang",
                                    F.col("quality").cast("int").alias("quality")),
                           "doc_id", ["f_len", "f_digits", "f_lines"], ["lang"], "quality", k=5, seed=42)
    return out.groupBy("quality", "is_synthetic").agg(F.count(F.lit(1)).alias("n"))


register("smotenc", """WITH c AS (SELECT quality, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY quality),
m AS (SELECT max(n) AS mx FROM c)
SELECT quality, false AS is_synthetic, n FROM c
UNION ALL SELECT quality, true, mx - n FROM c, m WHERE mx > n""")(q_smotenc)


def q_shap_sampled(spark, sf):
    d = clf_data(spark, sf)
    data = training.assemble(d, "doc_id", CLF_FEATS, "quality")
    m = models.make("logreg", C=1.0).fit(data)
    return explain.shap_sampled(m, d, "doc_id", CLF_FEATS, d, n_samples=8, seed=3)


register("shap_sampled")(q_shap_sampled)


def q_model_save(spark, sf):
    tr, te = _clf_split(spark, sf)
    path = save_model(models.make("logreg", C=1.0).fit(tr), scratch_path(spark, "model"))
    return load_model(path).transform(te).select("doc_id", F.col("prediction").cast("int").alias("prediction"))


register("model_save")(q_model_save)

SAVED_KINDS = {"logreg": {"C": 1.0}, "forest_clf": {"n_estimators": 5}, "adaboost": {"n_estimators": 3},
               "kernel_clf": {"n_components": 20, "length_scale": 2.0}, "knn_clf": {"n_neighbors": 3}, "bayes_ridge": {}}


def q_model_load(spark, sf):
    """Rows whose prediction changes when a model is saved and loaded, per kind."""
    tr, te = _clf_split(spark, sf)
    out = None
    for kind, params in SAVED_KINDS.items():
        model = models.make(kind, **params).fit(tr)
        back = load_model(save_model(model, scratch_path(spark, "model")))
        one, two = (m.transform(te).select("doc_id", F.col("prediction").alias(n)) for m, n in ((model, "p"), (back, "q")))
        part = one.join(two, "doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("p").eqNullSafe(F.col("q"))).alias("differ")) \
            .withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


register("model_load", "SELECT kind, ceil(count(*) * 0.2)::BIGINT AS n, 0::BIGINT AS differ FROM documents JOIN labels USING (doc_id), (VALUES "
         + ", ".join(f"('{k}')" for k in SAVED_KINDS) + ") t(kind) GROUP BY kind")(q_model_load)


def q_sink_grid(spark, sf):
    from moltab.session import scratch_path
    from moltab.sources import io
    tr, _ = _reg_split(spark, sf)
    g = training.grid_search(tr, "o_orderkey", "lasso", [{"alpha": 0.01}, {"alpha": 0.1}], n_folds=3)
    out = io.write_table(g, scratch_path(spark, "grid"), fmt="csv")
    return spark.read.schema(g.schema).option("header", True).csv(out)


register("sink_grid")(q_sink_grid)


def q_smoten(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    data = d.select("doc_id", "lang", "source", F.col("quality").cast("int").alias("quality"))
    out = resample.smoten(data, "doc_id", ["lang", "source"], "quality", k=5, seed=42)
    return out.groupBy("quality", "is_synthetic").agg(F.count(F.lit(1)).alias("n"))


register("smoten", """WITH c AS (SELECT quality, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY quality),
m AS (SELECT max(n) AS mx FROM c)
SELECT quality, false AS is_synthetic, n FROM c
UNION ALL SELECT quality, true, mx - n FROM c, m WHERE mx > n""")(q_smoten)


WORKFLOW_MODELS = {"logreg": ("logreg", [{"C": 1.0}]), "dtree": ("dtree_clf", [{"max_depth": 3}])}


def _workflow(spark, sf):
    from moltab.plans.workflow import cross_validate
    return cross_validate(clf_data(spark, sf), "doc_id", CLF_FEATS, "quality", WORKFLOW_MODELS, n_folds=10, scale="minmax")


def q_kfold_clf_folds(spark, sf):
    """Ten folds, two models, the scaler fitted per fold: every row is predicted once."""
    p = _workflow(spark, sf).predictions
    return p.groupBy("model", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("known").cast("long").alias("positives"))


register("kfold_clf_folds", f"""WITH d AS (SELECT doc_id, quality, ntile(10) OVER (
    ORDER BY {sql_hash32(sql_key("doc_id"), sql_lit(42), sql_lit("outer"))}, doc_id) - 1 AS fold
  FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL)
SELECT model, fold::INT AS fold, count(*) AS n, sum(quality)::BIGINT AS positives
FROM d, (VALUES ('logreg'), ('dtree')) m(model) GROUP BY model, fold""")(q_kfold_clf_folds)


def q_kfold_clf_summary(spark, sf):
    return _workflow(spark, sf).summary()


register("kfold_clf_summary")(q_kfold_clf_summary)
